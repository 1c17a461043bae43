from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from rallypoint.llm.queries import ORACLES
from tests.llm.helpers import odd_documents
from tests.llm.test_packing import check
from tests.llm.test_secret_scan import OTHERS, plain
from tests.llm.test_simhash import plain_groups, plain_print

FURTHER = {**OTHERS, "github": r"gh[pousr]_[A-Za-z0-9]+", "slack": r"xox[abprs]-[A-Za-z0-9-]+"}
LEAST = {"jwt": 30, "google": 39, "npm": 40, "github": 40, "slack": 20}
TAILS = {"stripe": (8, 16), "gitlab": (6, 20)}


def plain_mask(text):
    """Runs of overlapping secrets become [kind] of the first, by regular expressions alone."""
    assert "-----BEGIN" not in text
    order = ["assign", "access", "hex", "github", "slack", "jwt", "google", "stripe", "gitlab", "npm", "url"]
    found = plain(text)
    for kind, rule in FURTHER.items():
        for m in re.finditer(rule, text):
            head, tail = TAILS.get(kind, (0, 0))
            if len(m[0]) >= LEAST.get(kind, 0) and len(m[0]) - head >= tail:
                found.append((m.start(), kind, m.end()))
    out, at = [], 0
    for a, kind, b in sorted(found, key=lambda x: (x[0], order.index(x[1]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_against_brute_force(spark, small):
    """Host rules and leaks by DuckDB, groups by all pairs, secrets by regular expressions, ids by the whole tokenizer."""
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM '{small}/{name}.parquet'")
    con.sql(f"DELETE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLES['op2_host_rules']}) WHERE kept)")
    rows = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    groups = plain_groups([plain_print(t) for _, t in rows])
    copies = [d for i, (d, _) in enumerate(rows) if groups[i] != i]
    con.sql(f"DELETE FROM documents WHERE doc_id IN ({', '.join(map(str, copies))})")
    leaking = {d for (d,) in con.sql(f"SELECT DISTINCT doc_id FROM ({ORACLES['op10_template_windows']})").fetchall()}
    left = {d: plain_mask(t) for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall() if d not in leaking}
    assert copies and leaking and any(left[d] != t for d, t in rows if d in left)
    out = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in out} == set(left)
    check(out, left, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_stages_return_the_columns_of_documents(spark, small):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).count() == 0, name


def test_stages_on_odd_rows(spark, small):
    """Nulls, blanks, ties, repeated rows and a very long text, stage by stage."""
    docs = odd_documents(spark)
    counts = {name: stage(spark, docs, small) for name, stage in corpus_pipeline.STAGES}
    texts = lambda df: sorted((r["text"] for r in df.collect()), key=str)
    assert all(t is not None and len(t.split()) >= 50 for t in texts(counts["quality"]))
    prints = [plain_print(r["text"]) for r in docs.collect()]
    assert counts["near_dedup"].count() == len(set(plain_groups(prints)))
    assert texts(counts["decontamination"]) == texts(counts["secrets"]) == texts(docs)
    assert counts["packed"].where("piece = 0").count() == docs.count()
