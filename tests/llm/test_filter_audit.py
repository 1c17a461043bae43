from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from rallypoint.llm import filter_audit, queries, sql
from tests.compare import same_rows
from tests.llm.helpers import no_documents, odd_documents, words

LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    """docs: (doc_id, text, source); every document walks through every order."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    failing = []
    for i, t, s in docs:
        t = t or ""
        w, first = words(t), smallest.get(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (i is None or i > first)}
        failing.append((s or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {x[0] for x in failing}:
        own = [x for x in failing if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), sum(f in x[1] for x in own) - len(removed), sum(x[1] == {f} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows(df):
    assert tuple(df.columns) == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_sql_and_walking(spark, duck, small):
    got = queries.QUERIES["op12_filter_audit"](spark, small)
    same_rows(got, duck.sql(sql.OP12))
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(got) == brute(docs, labels)


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_runs_over_partition_ends(spark, partitions):
    """Few texts over many partitions: runs begin, end and fill whole partitions, with ties and null ids."""
    docs = [(i % 50 if i % 11 else None, ("same " * 60 if i % 3 else f"text {i % 4} #"), "ab"[i % 2]) for i in range(400)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 3)] + [(3, None, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(filter_audit.audit(df, spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], LABELS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(docs, labels)


def test_odd_rows(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], LABELS)
    some = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert rows(filter_audit.audit(docs, none)) == brute(some, [])
    labels = [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)]
    assert rows(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == brute(some, labels)
    assert filter_audit.audit(no_documents(spark), none).count() == 0


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x")], "name string, body string").withColumn("host", F.lit(None).cast("string"))
    got = {r.doc_id: r.mask for r in filter_audit.failure_masks(docs, "body", "name", "host").collect()}
    assert {k: bool(v & filter_audit.DUPLICATE) for k, v in got.items()} == {"a": False, "b": True, "c": True}
