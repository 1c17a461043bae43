from __future__ import annotations

import random

import numpy as np
from xxhash import xxh64_intdigest

from rallypoint.llm import simhash as s
from rallypoint.llm.components import components
from rallypoint.llm.queries import QUERIES
from tests.llm.helpers import LOWER, no_documents, odd_documents, words


def plain_print(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """index -> least index reachable over links of 3 bits or fewer."""
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_query_against_brute_force(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    prints = [plain_print(r["text"]) for r in docs]
    want = {docs[i]["doc_id"]: (f"{p:016x}", docs[g]["doc_id"]) for i, (p, g) in enumerate(zip(prints, plain_groups(prints), strict=True))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_variants"](spark, small).collect()}
    assert got == want


def test_links_of_random_and_close_prints(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp bigint")
    for block in (4096, 2):  # one task a bucket, and pairs of tiny blocks
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(s.near_links(df, block)).collect()}
        found = [prints.index(roots.get(p, p)) for p in prints]
        want = plain_groups(prints)
        assert len(set(zip(found, want, strict=True))) == len(set(want)) == len(set(found))


def test_spanning_links_stay_few():
    values = np.array([1 << k for k in range(64)] + [0], np.uint64)
    assert len(s.spanning_links(values)) == 64


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = s.group_near(docs).collect()
    assert len(got) == docs.count()
    blank = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert blank == {0}
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert kept.count() == len({r["component_id"] for r in got})
    assert s.keep_one(no_documents(spark)).count() == 0 and s.group_near(no_documents(spark)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[501] == 500 and len(got) == 303


def test_hot_keys_meet_without_a_shuffle(spark):
    from rallypoint.llm import common as c

    many = spark.createDataFrame([(0, i) for i in range(900)] + [(i, i) for i in range(1, 100)], "k bigint, v bigint")
    one = spark.createDataFrame([(i, -i) for i in range(50)], "at bigint, w bigint")
    hot = c.hot_keys(many.groupBy("k").count(), "k", "count", 999 * 200)
    assert hot == [0]
    want = sorted(tuple(r) for r in many.join(one, many.k == one.at).collect())
    assert sorted(tuple(r) for r in c.join_unique(many, one, ("k", "at"), hot).collect()) == want == sorted(tuple(r) for r in c.join_unique(many, one, ("k", "at"), []).collect())


def test_components_of_a_star_and_of_odd_links(spark):
    links = [(0, i) for i in range(1, 3000)] + [(5000, 5001), (5001, 5002), (5002, 5002), (None, 7), (8, None), (5001, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == dict.fromkeys(range(3000), 0) | dict.fromkeys((5000, 5001, 5002), 5000)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
