from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rallypoint.llm import queries, sql, vector_codes
from tests.compare import same_rows

FIELDS = "vec_id bigint, embedding array<float>, label int, code string, error double"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds in Python's whole numbers; rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = max(1, -(-len(kept[0][1]) // parts)) if kept else 1
    vectors = [[math.floor(np.float32(x).astype(float) * 4096) for x in r[1]] + [0] * (parts * size - len(r[1])) for r in kept]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(p, part):
        return min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(p, c[p]) for c in cut]
            groups = [[c[p] for c, o in zip(cut, own) if o == e] for e in range(len(books[p]))]
            books[p] = [[sum(x) // len(g) for x in zip(*g)] if g else old for g, old in zip(groups, books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((repr(r[0]), "".join(f"{x:02x}" for x in k), e, by_label[r[2]], digest) for r, k, e in zip(kept, codes, errors))


def rows(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def table_of(spark, some):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in some], FIELDS)


def test_query_equals_sql(spark, duck, small):
    same_rows(queries.QUERIES["op11_filtering_lloyd"](spark, small), duck.sql(sql.OP11))


@pytest.mark.parametrize("chunk_values", [64, 3000, 1 << 20])
def test_chunks_and_ties(spark, chunk_values):
    """Few values, so that distances tie and entries are equal or unused; one vector is a third of the rows."""
    rng = np.random.default_rng(3)
    some = [(i if i % 9 else None, [0.25] * 16 if i % 3 == 0 else (rng.integers(-2, 3, 16) / 4096).tolist(), i % 4 if i % 5 else None) for i in range(300)]
    assert rows(vector_codes.compress(table_of(spark, some).repartition(5), chunk_values=chunk_values)) == brute(some)


def test_odd_rows(spark):
    some = [(5, [1.0, -0.5, 0.25], 1), (5, [1.0, -0.5, 0.25], 1), (4, None, 1), (3, [1.0, None, 2.0], 1), (2, [float("nan"), 1.0, 1.0], 1), (1, [float("inf"), 0.0, 0.0], 1), (6, [1.0], 2), (None, [0.1, 0.2, 0.3], None), (7, [1e-9, -1e-9, 0.0], None), (8, [], 3)]
    got = rows(vector_codes.compress(table_of(spark, some)))
    assert got == brute(some) and len(got) == 4
    assert vector_codes.compress(table_of(spark, some).limit(0)).count() == 0
    assert vector_codes.compress(table_of(spark, [(1, None, 1)])).count() == 0
    assert rows(vector_codes.compress(table_of(spark, [(1, [], 1), (2, [], 1)]))) == brute([(1, [], 1), (2, [], 1)])
    huge = vector_codes.compress(table_of(spark, [(1, [3e38, -3e38], 1), (2, [32768.0, -32768.0], 1), (3, [0.0, 0.0], 1)]), entries=1, rounds=0).collect()
    assert {r.vec_id: r.error for r in huge} == {1: 0, 2: 2 * (2**29 - 2**27) ** 2, 3: 2 * 2**58}


@pytest.mark.parametrize("n,d,spread", [(1, 1, 5), (31, 3, 2), (33, 2, 100), (1000, 8, 3), (5000, 8, 2000), (4000, 4, 1), (700, 5, 1 << 26)])
def test_filter_equals_looking_at_every_point(n, d, spread):
    rng = np.random.default_rng(n + d)
    points = rng.integers(-spread, spread + 1, (n, d))
    tree = vector_codes.Tree.of(points)
    for k in (1, 2, 16):
        entries = points[rng.integers(0, n, k)] + rng.integers(-1, 2, (k, d))
        want = vector_codes.distances(points, entries).argmin(1)
        total, count, codes = tree.filter(entries)
        assert (codes == want[tree.order]).all() and (count == np.bincount(want, minlength=k)).all()
        assert (total == np.array([points[want == e].sum(0) for e in range(k)])).all()


def test_whole_subtrees_are_assigned():
    """Points in clusters: hardly any leaf is looked at."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    tree = vector_codes.Tree.of(centres[rng.integers(0, 16, 20_000)] + rng.integers(-5, 6, (20_000, 8)))
    looked = []
    plain = vector_codes.distances
    vector_codes.distances = lambda points, entries: looked.append(len(points)) or plain(points, entries)
    try:
        tree.filter(centres)
    finally:
        vector_codes.distances = plain
    assert sum(looked) < 8000
