from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from rallypoint.llm import token_counts as t
from rallypoint.llm.queries import QUERIES
from tests.llm.helpers import no_documents, odd_documents, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word):
    """Best score, then fewest pieces, over every segmentation, prefix by prefix from scratch."""
    scores = t.vocabulary(PATH).scores
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        options = [(best[d - 1][0] + n * t.BYTE_SCORE, best[d - 1][1] - n)]
        options += [(best[k][0] + scores[word[k:d]], best[k][1] - 1) for k in range(d) if word[k:d] in scores]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abetinghd1é中😀", min_size=1, max_size=14), min_size=1, max_size=20))
def test_trie_equals_single_words(found):
    trie = t.PrefixTrie(t.vocabulary(PATH))
    in_order = sorted(set(found))
    assert [trie.insert(t.MARK + x) for x in in_order] == [plain(t.MARK + x) for x in in_order]


def test_terminal_counts_are_stored_once_a_word(spark):
    texts = ["the internet and the international internals", "inter internal the", None, "", "internation international"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    got = {r.h: (r.pieces, r.n) for r in t.word_pieces(docs, PATH, words_per_task=4).collect()}
    every = [w for x in texts for w in words(x)]
    assert got == {int(t._hashes([w.encode()], 1)[0]): (plain(t.MARK + w), every.count(w)) for w in every}


def test_known_or_joined_words_count_alike(spark):
    docs = odd_documents(spark)
    want = sorted(map(tuple, t.count_tokens(docs).collect()), key=str)
    for share in (1, 100):
        assert sorted(map(tuple, t.count_tokens(docs, known_share=share, words_per_task=100).collect()), key=str) == want


def test_shared_prefixes_are_scored_once():
    trie = t.PrefixTrie(t.vocabulary(PATH))
    for word in sorted(["inter", "internal", "international", "internet"]):
        trie.insert(word)
    assert trie.scored == len("internal") + len("tional") + len("et")


def test_query(spark, small):
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op9_trie_counts"](spark, small).collect()
    memo = {}
    for r in rows:
        w = docs[r["doc_id"]]
        for x in set(w) - set(memo):
            memo[x] = plain(t.MARK + x)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(w), sum(memo[x] for x in w))
    assert {r["doc_id"] for r in rows} == set(docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = t.count_tokens(docs).collect()
    assert sorted(r["n_pretokens"] for r in got) == sorted(len(words(r["text"])) for r in docs.collect())
    assert t.count_tokens(no_documents(spark)).count() == 0
