from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from rallypoint.llm import brown_lm as b
from rallypoint.llm.queries import QUERIES
from tests.llm.helpers import LOWER, no_documents, odd_documents, words


def tokens_of(text):
    return [*words((text or "").translate(LOWER)), "\n"]


def test_query_against_plain_counts(spark, small):
    docs = {r["doc_id"]: tokens_of(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    c = Counter(w for d, t in docs.items() if crc32(str(d).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op4_brown_classes"](spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def packed(spark, counts):
    rows = [(i, j, side, int(counts[i, j] if side == 0 else counts[j, i])) for side in (0, 1) for i in range(len(counts)) for j in range(len(counts))]
    df = spark.createDataFrame([r for r in rows if r[3]], "own int, other int, side int, n bigint")
    return df.repartition(3, "own").mapInArrow(b.pack_core, b.PACKED)


def start(size, classes):
    return np.append(np.arange(size - 1) % (classes - 1), classes - 1)


def test_exchange_finds_planted_classes(spark):
    rng = np.random.default_rng(1)
    own = np.arange(30) % 3
    counts = np.zeros((31, 31), np.int64)
    word = 0
    for _ in range(30_000):
        then = int(rng.choice(np.flatnonzero(own == (own[word] + 1) % 3)))
        counts[word, then] += 1
        word = then
    found, table = b.exchange(packed(spark, counts), start(31, 4)[[*rng.permutation(30), 30]], 4, 0.0)
    assert found[30] == 3 and table.sum() == counts.sum()
    assert all(len({found[i] for i in range(30) if own[i] == k}) == 1 for k in range(3))


def test_exchange_never_loses_likelihood(spark):
    counts = np.random.default_rng(2).poisson(0.3, (40, 40))
    first = start(40, 6)
    member = np.eye(6)[first]
    found, table = b.exchange(packed(spark, counts), first, 6)
    assert np.array_equal(table, np.eye(6)[found].T @ counts @ np.eye(6)[found])
    assert b.likelihood(table) >= b.likelihood(member.T @ counts @ member)


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(3)
    table, r, l = rng.integers(0, 9, (5, 5)).astype(float), rng.integers(0, 4, 5).astype(float), rng.integers(0, 4, 5).astype(float)  # noqa: E741
    found = b.gains(table, r, l, 2.0)
    exact = []
    for k in range(5):
        with_word = table.copy()
        with_word[k] += r
        with_word[:, k] += l
        with_word[k, k] += 2
        exact.append(b.likelihood(with_word))
    assert found - found[0] == pytest.approx(np.array(exact) - exact[0])


TEXTS = ["a b c a b", "b c d a b e", "", "a a f b c", "g h a b c d", "x y z a b", "a b g h", "e e e f x y z"] * 2 + ["q"]


def lines(spark, texts=TEXTS):
    return spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)


def test_every_word_has_a_class_from_its_own_bigrams(spark):
    words, cells, n_core = b.class_words(lines(spark), classes=4, core_words=3)
    got = {r.h: (r.n, r["class"]) for r in words.collect()}
    seen = Counter(w for t in TEXTS for w in tokens_of(t))
    assert n_core == 3 and {h: n for h, (n, _) in got.items()} == {b._hash(w.encode()): n for w, n in seen.items()}
    pairs = Counter(p for p in zip(["\n"] + [w for t in TEXTS for w in tokens_of(t)], [w for t in TEXTS for w in tokens_of(t)]))
    own = {w: got[b._hash(w.encode())][1] for w in seen}
    expected = np.zeros((4, 4))
    for (x, y), n in pairs.items():
        expected[own[x], own[y]] += n
    assert np.array_equal(cells, expected)
    core = {*sorted((w for w in seen if w != "\n"), key=lambda w: (-seen[w], b._hash(w.encode())))[:3], "\n"}
    table = np.zeros((4, 4))
    for (x, y), n in pairs.items():
        if x in core and y in core:
            table[own[x], own[y]] += n
    f = lambda x: x * math.log(max(x, 1))
    for w in set(seen) - core:
        value = []
        for k in range(3):
            new, rows, columns = table.copy(), table.sum(1), table.sum(0)
            for (x, y), n in pairs.items():
                if x == w and y in core:
                    new[k, own[y]] += n
                    columns[own[y]] += n
                if y == w and x in core:
                    new[own[x], k] += n
                    rows[own[x]] += n
            sums = sum(f(s[k] + seen[w]) - f(s[k]) for s in (rows, columns))
            value.append(sum(map(f, new.reshape(-1))) - sums)
        assert value[own[w]] == pytest.approx(max(value))


@pytest.mark.parametrize("known_share", [1 << 22, 8, 1])
def test_scores_against_plain_products(spark, known_share):
    """Word by word, whatever share of the words travels to the tasks."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "a new word", "q w e a", None])], "doc_id bigint, text string")
    train = docs.where(~b.held_out(docs["doc_id"])).select("text")
    model, words = b.fit(train, 4, 3, known_share)
    own = {r.h: (r.n, r["class"]) for r in words.collect()}
    n = Counter()
    v = Counter()
    for c, k in own.values():
        n[k] += c
        v[k] += 1
    step = 10**model.step
    out = b.score(docs, classes=4, core_words=3, known_share=known_share).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts)
    for r in out:
        total, before = 0.0, 3
        for w in tokens_of(texts[r.doc_id]):
            c, k = own.get(b._hash(w.encode()), (0, 4))
            total += math.log10(step[before, k]) + (math.log10((c + 0.1) / (n[k] + 0.1 * (v[k] + 1))) if k < 4 else 0)
            before = k
        assert r.score == pytest.approx(total, rel=1e-9)


def test_model_sums_to_one(spark):
    model, words = b.fit(lines(spark, ["a b c a b", "b c d", ""]), classes=4, core_words=2)
    step = 10**model.step
    assert np.allclose(step[:, :-1].sum(1), 1) and (model.tokens, model.distinct) == (11, 5)
    emit = np.zeros(4)
    for r in words.collect():
        emit[r["class"]] += (r.n + 0.1) / 10 ** model.size[r["class"]]
    unseen = 0.1 / 10**model.size
    assert np.allclose(emit + unseen, [1 if e else u for e, u in zip(emit, emit + unseen)])
    assert np.allclose(step[:, :-1] @ unseen, step[:, -1])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = b.score(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert b.score(no_documents(spark)).count() == 0
    only_held = docs.where("doc_id IS NULL")
    assert [r["n_known"] for r in b.score(only_held).collect()] == [0]


def recount(counts, found, classes):
    member = np.eye(classes)[found]
    return member.T @ counts @ member


@pytest.mark.parametrize("seed", range(12))
def test_one_part_is_plain_exchange(seed):
    """Word by word as a plain exchange that recounts the whole table for every choice."""
    rng = np.random.default_rng(seed)
    size, classes = 24, 5
    counts = rng.poisson(0.4, (size, size)) * rng.integers(1, 6, (size, size))
    first = start(size, classes)
    rows = [(i, j, side, int(counts[i, j] if side == 0 else counts[j, i])) for side in (0, 1) for i in range(size) for j in range(size)]
    batch = b.pa.RecordBatch.from_pydict({c: [r[k] for r in rows if r[3]] for k, c in enumerate(("own", "other", "side", "n"))})
    moved = list(b.move_part(b.pack_core(iter([batch])), first, recount(counts, first, classes)))[0].to_pydict()
    got = first.copy()
    got[moved["word"]] = moved["class"]
    found = first.copy()
    off = counts * (1 - np.eye(size))
    weight = off.sum(0) + off.sum(1) + 2 * counts.diagonal()
    words = np.flatnonzero(counts.sum(0) + counts.sum(1))
    for w in words[np.argsort(-weight[words], kind="stable")]:
        if w == size - 1:
            continue
        value = []
        for k in range(classes - 1):
            found_k = found.copy()
            found_k[w] = k
            value.append(b.likelihood(recount(counts, found_k, classes)))
        best = int(np.argmax(value))
        if value[best] > value[found[w]] + 1e-6:
            found[w] = best
    assert np.array_equal(got, found)
    assert b.likelihood(recount(counts, got, classes)) >= b.likelihood(recount(counts, first, classes))


def test_no_sweep_loses_and_the_table_is_a_recount(spark):
    """Several parts side by side, until nothing gains: the likelihood of every accepted sweep rises."""
    counts = np.random.default_rng(5).poisson(0.5, (60, 60))
    seen, original = [], b.likelihood
    found, table = b.exchange(packed(spark, counts), start(60, 7), 7, 0.0)
    assert np.array_equal(table, recount(counts, found, 7))
    member = start(60, 7)
    assert original(table) > original(recount(counts, member, 7))
    # At the end no single word gains by a move.
    for w in range(59):
        for k in range(6):
            other = found.copy()
            other[w] = k
            seen.append(original(recount(counts, other, 7)))
    assert max(seen) <= original(table) + 1e-5
