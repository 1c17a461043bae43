from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rallypoint.llm import packing as p
from rallypoint.llm.queries import QUERIES
from tests.llm.helpers import no_documents, odd_documents


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, whole):
    """Pieces hold each document's ids in order, and sequences have neither gaps nor overlaps."""
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], []).append(r)
    for doc, pieces in by_text.items():
        ids = np.array([*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
    return len(places)


def test_query(spark, small, whole):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op7_best_fit"](spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert check(rows, texts, whole) <= least * 1.02 + 1


def test_query_closes_bins_as_pieces_arrive(spark, small):
    """The query's own places, found again piece by piece; its bound on open bins is met all the time."""
    folder = small.replace("sf0.001", "sf0.01")
    df = QUERIES["op7_best_fit"](spark, folder)
    rows = df.collect()
    assert len({r["sequence_id"] >> 40 for r in rows}) == 1
    bins, placed = p.OpenBins(2048, p.OPEN_BINS), {}
    for r in rows:
        placed[r["doc_id"], r["piece"]] = bins.place(r["length"])
    assert placed == {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in rows}
    assert bins.closed > 50 and bins.n_open <= p.OPEN_BINS
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert bins.next <= 1.05 * least


def test_odd_rows(spark, whole):
    docs = odd_documents(spark).dropDuplicates(["doc_id"])
    rows = p.pack(docs).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, whole)
    assert p.pack(odd_documents(spark)).where("piece = 0").count() == odd_documents(spark).count()
    assert p.pack(no_documents(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'sdÉßıŉİſ0 \n.!<|endoftext|>éΣ -_"), max_size=60))
def test_ids_of_any_text(whole, text):
    import pyarrow as pa

    ids, counts = p.texts_ids(pa.array([text]), p.word_ids(public_tokenizers.path("word_bpe_49k.json")))
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_bounded_bins_close_the_fullest():
    bins = p.OpenBins(10, 2)
    assert bins.place(9) == (0, 0) and bins.place(8) == (1, 0)
    assert bins.place(7) == (2, 0)  # two bins were open: the one with a single free place closed
    assert bins.place(1) == (1, 8) and bins.place(2) == (2, 7)
    assert {bins.place(1), bins.place(1)} == {(1, 9), (2, 9)}
    assert bins.place(10) == (3, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 5))
def test_bins_never_overflow(lengths, most):
    bins, used = p.OpenBins(20, most), {}
    for n in lengths:
        b, at = bins.place(n)
        assert used.get(b, 0) == at and at + n <= 20 and bins.n_open <= most
        used[b] = at + n
