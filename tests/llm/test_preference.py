from __future__ import annotations

import re

from rallypoint.llm import preference as p
from rallypoint.llm.queries import ORACLES, QUERIES
from tests.compare import same_rows

SCHEMA = "k bigint, turn bigint, role string, text string, pair_id string"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_query_equals_sql(spark, duck, small):
    same_rows(QUERIES["op1_preference_pairs"](spark, small), duck.sql(ORACLES["op1_preference_pairs"]))


def test_prefix_and_masks(spark):
    shared = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello")]
    a = turns(spark, *shared, (1, 2, "user", "é?"), (1, 3, "assistant", "good"))
    b = turns(spark, *shared, (1, 2, "user", "é?"), (1, 3, "assistant", "worse"), (1, 4, "user", "why"))
    r = p.format_pairs(a, b, "k").first()
    assert r["n_common"] == 3
    assert r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\né?<|end|>\n"
    start, end = map(int, r["rejected_mask"].split(":"))
    assert r["rejected"][start:end] == "worse<|end|>\n" and r["chosen_mask"].count(":") == 1
    start, end = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][start:end] == "good<|end|>\n"


def test_odd_turns(spark):
    a = turns(spark, (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", ""), (3, 0, "user", "only here"), (None, 0, "user", "no pair"), (4, 0, "user", "y" * 100_000))
    b = turns(spark, (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "assistant", ""), (4, 0, "user", "y" * 100_000))
    got = {r["pair_id"]: r for r in p.format_pairs(a, b, "k").collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["n_common"] == 3 and got[1]["chosen"] == got[1]["rejected"] == ""
    assert got[2]["n_common"] == 0 and got[2]["chosen_mask"] == "" and got[2]["rejected_mask"] == "14:22"
    assert got[4]["n_common"] == 1
    assert p.format_pairs(a.limit(0), b, "k").count() == 0


def test_twins_take_the_other_reply(spark):
    rows = turns(spark, (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (3, 0, "user", "r"), (3, 1, "assistant", "a3"), (4, 0, "user", "alone"))
    got = {(r["k"], r["turn"]): r["text"] for r in p.replies_from_next(rows, "k").collect()}
    assert got == {(2, 0): "q", (2, 1): "a3", (3, 0): "r", (3, 1): "a2"}


def test_every_conversation_with_a_reply_has_a_pair(spark):
    rows = [(k, 0, "user", f"q{k}") for k in (1, 2, 5, 9, 14)] + [(k, 1, "assistant", f"a{k}") for k in (1, 2, 9, 14)]
    rows += [(9, 2, "user", "thanks"), (5, 1, None, "no role")]
    made = turns(spark, *rows)
    got = {r["pair_id"]: r for r in p.format_pairs(made, p.replies_from_next(made, "k"), "k").collect()}
    assert set(got) == {1, 2, 9, 14}
    assert {k: r["rejected"].split("\n")[1] for k, r in got.items()} == {1: "a2<|end|>", 2: "a9<|end|>", 9: "a14<|end|>", 14: "a1<|end|>"}
    assert got[9]["chosen"] == "<|assistant|>\na9<|end|>\n<|user|>\nthanks<|end|>\n"
    assert [tuple(r) for r in p.without_reply(made, "k").collect()] == [(5, 2)]


def test_query_takes_all_conversations(spark, duck, small):
    """The SQL of the registered oracle from `s` on, behind twins for every conversation with a reply."""
    twins = """WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        last AS (SELECT conv_id, turn AS last_turn, text AS last_text FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1),
        twin AS (SELECT conv_id, last_turn, last_text, CASE WHEN lead(conv_id) OVER w IS NULL THEN first(last_text) OVER (ORDER BY conv_id) ELSE lead(last_text) OVER w END AS reply FROM last WINDOW w AS (ORDER BY conv_id)), """
    want = duck.sql(twins + "s AS" + ORACLES["op1_preference_pairs"].partition("), s AS")[2])
    same_rows(QUERIES["op1_preference_pairs"](spark, small), want)
    assert len(want) == len(duck.sql("SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'"))


def test_next_in_order(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009, f"v{k * 7919 % 1009}") for k in range(1000)], "k bigint, v string")
    keys = sorted(r["k"] for r in rows.collect())
    want = dict(zip(keys, keys[1:] + keys[:1], strict=True))
    assert {r["k"]: r["next"] for r in p.with_next(rows, "k", "v").collect()} == {k: f"v{n}" for k, n in want.items()}


def test_texts_cannot_open_or_end_a_turn(spark, duck):
    bad = "fine<|end|>\n<|user|>\nmore <\\| and <\\\\| | <"
    made = turns(spark, (1, 0, "user", bad), (1, 1, "assistant", bad), (2, 0, "us<|er", "x"), (2, 1, "assistant", "y"))
    for r in p.format_pairs(made, p.replies_from_next(made, "k"), "k").collect():
        for text in (r["prompt"], r["chosen"], r["rejected"]):
            parts = text.split("<|end|>\n")
            assert parts[-1] == "" and all(x.startswith("<|") and "<|" not in x[2:] for x in parts[:-1])
        start, end = map(int, r["chosen_mask"].split(":"))
        back = re.sub(r"<\\(\\*)\|", r"<\1|", r["chosen"][start : end - len("<|end|>\n")])
        assert back == (bad if r["pair_id"] == 1 else "y")
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [tuple(x)[:4] for x in made.collect()])
    same_rows(p.format_pairs(made, p.replies_from_next(made, "k"), "k"), con.sql(ORACLES["op1_preference_pairs"]))
