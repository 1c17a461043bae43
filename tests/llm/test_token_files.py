from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallypoint.llm import queries, token_files
from tests.llm.helpers import LONG, ODD_TEXTS, no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True


def plain(texts):
    return [[*WHOLE.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def encoded(texts):
    out, known = [], token_files.segment_ids(PATH)
    for ids, counts in token_files.texts_ids(pa.array(texts, pa.string()), known):
        at = np.concatenate(([0], np.cumsum(counts)))
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\xa0", " ", "\x1c", "a", "the", "don't", "It's", "3.14", "x,", "é", "naïve", "Ñ", "日本", "😀", "²", "ª", "<|endoftext|>", "_", "—", "\x00", "\x7f", "'", "ĳ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=4))
def test_segments_give_the_tokenizers_ids(texts):
    assert encoded(texts) == plain(texts)


def test_odd_texts_give_the_tokenizers_ids():
    assert encoded(list(ODD_TEXTS)) == plain(ODD_TEXTS)


def brute(rows):
    out, start = [], 0
    for doc_id, ids in rows:
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_perfect_hash_shards"](spark, small).collect()]
    assert sorted(got) == brute(zip([x for x, _ in docs], plain([t for _, t in docs])))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(plain([r.text])[0])
    assert [r.doc_id for r in got] == sorted((x for x, y in want.items() for _ in y), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    for key, ids in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == key) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)
    assert token_files.round_trip(no_documents(spark)).count() == 0


def test_a_doc_id_with_a_third_of_all_rows_spans_shards(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = token_files.write(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.shards.count() == 4
    got = token_files.read(files)
    rows = got.collect()
    assert len(rows) == 3000 and {r.number for r in rows if r.doc_id == 7} == set(range(sum(r.doc_id == 7 for r in rows)))
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in plain([f"text {i % 900}" for i in range(3000)]))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_keyed_access(spark):
    docs = spark.createDataFrame([(i, f"document {i} " + "word " * (i % 50)) for i in range(500)] + [(None, LONG), (3, "again")], "doc_id bigint, text string")
    files = token_files.write(docs)
    one = token_files.KeyedIds(files, {r.part: r.file for r in files.index.collect()}, {r.shard: r.file for r in files.shards.collect()})
    assert one.get("=17:0").tolist() == plain(["document 17 " + "word " * 17])[0]
    assert one.get("null:0").tolist() == plain([LONG])[0]
    assert {tuple(one.get(f"=3:{i}").tolist()) for i in range(2)} == {tuple(x) for x in plain(["document 3 " + "word " * 3, "again"])}
    assert one.get("=3:2") is None and one.get("=777:0") is None
    asked = spark.createDataFrame([(17, 0), (17, 0), (777, 0), (None, 0)], "doc_id bigint, number bigint")
    found = {r.doc_id: r.n_tokens for r in token_files.look_up(files, asked).collect()}
    assert found == {17: len(plain(["document 17 " + "word " * 17])[0]), 777: None, None: len(plain([LONG])[0])}
    ids = token_files.read(files, asked, keep_ids=True).where("doc_id = 17").first().ids
    assert ids == plain(["document 17 " + "word " * 17])[0]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_hash_is_perfect_and_minimal(n):
    hashes = token_files.key_hashes([f"={i}:0" for i in range(n)])
    function = token_files.PerfectHash.of(hashes)
    again = token_files.PerfectHash.load(function.dump())
    assert sorted(again.slots(hashes).tolist()) == list(range(n))
    if n > 1000:
        slots = np.zeros(n, token_files.SLOT)
        slots["fingerprint"], slots["offset"] = token_files._fingerprints(hashes), np.arange(n)
        raw = token_files.part_bytes(hashes, slots, 3)
        out, hit = token_files._found(hashes, raw, 3)
        assert hit.all() and (out["offset"] == np.arange(n)).all()
        others = token_files.key_hashes([f"={i}:1" for i in range(n)])
        assert not token_files._found(others, raw, 3)[1].any()
        assert len(function.dump()) * 8 / n < 5


def test_a_repeated_key_is_refused():
    with pytest.raises(ValueError):
        token_files.PerfectHash.of(token_files.key_hashes(["a", "a"]))
