from __future__ import annotations

from collections import Counter

import pytest

from rallypoint.llm import quality_rules as q
from rallypoint.llm.queries import ORACLES, QUERIES
from tests.compare import same_rows
from tests.llm.helpers import no_documents, odd_documents, words


def plain(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_query_equals_sql(spark, duck, small):
    same_rows(QUERIES["op2_host_rules"](spark, small), duck.sql(ORACLES["op2_host_rules"]))


def test_odd_rows_against_plain_python(spark):
    docs = odd_documents(spark)
    got = sorted(tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in q.score_hosts(docs).collect())
    assert got == sorted(plain(r["text"]) for r in docs.collect())


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "short", "bad.example") for i in range(200)] + [(1000 + i, good, f"h{i % 8}.example") for i in range(400)] + [(5000, good, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in q.score_hosts(docs).collect()}
    assert not got[0] and not got[1] and got[1000] and got[5000]
    assert {r["doc_id"] for r in q.filter_hosts(docs).collect()} == {i for i, k in got.items() if k}


def test_filter_returns_rows_unchanged(spark):
    docs = odd_documents(spark)
    out = q.filter_hosts(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).count() == 0


def test_empty(spark):
    assert q.score_hosts(no_documents(spark)).count() == 0
    assert q.filter_hosts(no_documents(spark)).count() == 0


@pytest.mark.parametrize("n", [0, 2, 3])
def test_few_words(n):
    import numpy as np

    assert q.repeated_words(np.arange(n), np.zeros(n, int), 1).tolist() == [0]


def test_prior_takes_chance_off():
    import numpy as np

    rng = np.random.default_rng(4)
    n = rng.integers(3, 40, 20_000).astype(float)
    k = rng.binomial(n.astype(int), rng.beta(4, 16, len(n))).astype(float)
    mean, weight = q.beta_prior(n.sum(), k.sum(), (k * k / n).sum(), (n * n).sum(), len(n))
    assert mean == pytest.approx(0.2, abs=0.01) and weight == pytest.approx(20, rel=0.1)
    chance = rng.binomial(n.astype(int), 0.2).astype(float)
    assert q.beta_prior(n.sum(), chance.sum(), (chance * chance / n).sum(), (n * n).sum(), len(n))[1] > 200
    assert q.beta_prior(5.0, 2.0, 0.8, 25.0, 1) == (0.4, 1000.0) and q.beta_prior(0, 0, 0, 0, 0) == (0.0, 1000.0)


def test_rules_count_apart_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    noisy, doubled = good + "#" * 40, "\n".join(f"{good} {i % 2}" for i in range(4))
    rows = [(i, (noisy, doubled, good)[i % 3], "mixed") for i in range(300)] + [(1000 + i, good, f"h{i % 20}") for i in range(600)] + [(5000, "short", "tiny"), (5001, good, "tiny")]
    got = {r["doc_id"]: r for r in q.score_hosts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [got[i]["rules_failed"] for i in (0, 1, 2)] == ["symbols", "base,dup_lines", ""]
    assert got[0]["kept"] and got[2]["kept"] and got[1000]["kept"] and got[5001]["kept"] and not got[5000]["kept"]
    assert got[5001]["host_rate"] < 0.5
