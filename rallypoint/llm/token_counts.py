"""Token counts by dynamic programming shared over a trie of pre-tokens.

A pre-token is a word with the word mark in front. Its best segmentation under a
unigram model of a public vocabulary is a forward score per prefix, so prefixes
that pre-tokens share are scored once. The table's distinct pre-tokens are
gathered first and dealt out by ranges, so that those with a common prefix meet;
each task inserts its range in order into a trie whose nodes hold the best score
and its number of pieces, and stores the terminal nodes' numbers: the counts.
Texts then look their words up. Words holding at least 1/KNOWN_SHARE of all
pre-tokens (so at most KNOWN_SHARE of them) travel to the tasks; the other words
of a text meet the stored counts in a join.

The unigram model gives the piece of rank r the probability 1 / (r + 2), up to a
common factor, in whole thousandths of a natural logarithm, so that scores are
exact: the public vocabulary has ranks and no probabilities of its own. Ties
take fewer pieces. A character that no piece covers falls back to its UTF-8
bytes.

Defined results for unusual input: a null, empty or blank text has no tokens; a
very long pre-token costs time in proportion to its length; a null doc_id stays
null; repeated rows are counted one by one; an empty table gives an empty
result; other columns, whatever their names, are never read. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rallypoint.llm.common import by_bytes, materialise, partitions_for, tokens

MARK = "▁"
KNOWN_SHARE = 1 << 22
#: Distinct pre-tokens whose prefixes a task shares, on average.
WORDS_PER_TASK = 1 << 16
#: Score of one byte that stands for itself, in thousandths.
BYTE_SCORE = -15_000


class Vocabulary:
    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, int] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.scores[model.id_to_piece(i)] = -round(1000 * math.log(rank + 2))
                rank += 1
        #: Lengths of the pieces that end with a given character, longest first.
        self.ending: dict[str, list[int]] = {}
        for piece in self.scores:
            lengths = self.ending.setdefault(piece[-1], [])
            if len(piece) not in lengths:
                lengths.append(len(piece))
        for lengths in self.ending.values():
            lengths.sort()


class PrefixTrie:
    """Pre-tokens inserted in order; a node is scored when its prefix first appears in the range.

    best[d] and pieces[d] belong to the node at depth d of the current path; a
    node that the next pre-token doesn't share can't be reached again, so it is
    let go.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.path = ""
        self.best, self.pieces = [0], [0]
        self.scored = 0

    def insert(self, word: str) -> int:
        """The number of pieces of word, which doesn't sort before earlier ones."""
        scores, ending, best, pieces = self.vocabulary.scores, self.vocabulary.ending, self.best, self.pieces
        shared = 0
        for a, b in zip(self.path, word):  # noqa: B905
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            c = word[d - 1]
            n = len(c.encode())
            top, count = best[d - 1] + n * BYTE_SCORE, pieces[d - 1] + n
            for length in ending.get(c, ()):
                if length > d:
                    break
                score = scores.get(word[d - length : d])
                if score is not None:
                    score += best[d - length]
                    if score >= top and (score > top or pieces[d - length] + 1 < count):
                        top, count = score, pieces[d - length] + 1
            best.append(top)
            pieces.append(count)
        self.scored += len(word) - shared
        self.path = word
        return pieces[-1]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker."""
    return Vocabulary(path)


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in by_bytes(batch.column("text")):
            coded = tokens(texts)[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.large_binary()).cast(pa.binary()), pa.array(n)], names=["word", "n"])


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w) - (1 << 63) for w in words), np.int64, n)


def score_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """h, pieces, n of words in order: a range's trie and the counts at its terminal nodes."""
    trie = PrefixTrie(vocabulary(path))
    for batch in batches:
        words = batch.column("word").to_pylist()
        pieces = np.fromiter((trie.insert(MARK + w.decode()) for w in words), np.int64, len(words))
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(words, len(words))), pa.array(pieces), batch.column("n")], names=["h", "pieces", "n"])


def word_pieces(docs: DataFrame, path: str, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """h, pieces, n of every distinct word of docs (column text)."""
    words = materialise(docs.mapInArrow(distinct_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ranges = words.repartitionByRange(partitions_for(words.count(), words_per_task), "word").sortWithinPartitions("word")
    return materialise(ranges.mapInArrow(lambda b: score_words(b, path), "h bigint, pieces bigint, n bigint"), "pieces")


def count_parts(batches: Iterator[pa.RecordBatch], known: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text a row of sums over known words (sorted hashes), and a row (h, n) per other word."""
    names, empty = ["row", "n_pretokens", "n_tokens", "h", "n"], lambda k: pa.nulls(k, pa.int64())
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column("text")):
            rows = batch.column("row").slice(done, len(texts))
            done += len(texts)
            words, n_words = tokens(texts)
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = _hashes(coded.dictionary.cast(pa.large_binary()).to_pylist(), len(coded.dictionary))
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            found = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            each = np.where(found, pieces[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
            doc = np.repeat(np.arange(len(texts)), n_words)
            sums = np.bincount(doc, each[codes], len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows, pa.array(n_words.astype(np.int64)), pa.array(sums), empty(len(texts)), empty(len(texts))], names=names)
            rare = ~found[codes] if len(hashes) else np.zeros(0, bool)
            key, n = np.unique(doc[rare] * max(1, len(hashes)) + codes[rare], return_counts=True)
            which, word = np.divmod(key, max(1, len(hashes)))
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(which)), empty(len(key)), empty(len(key)), pa.array(hashes[word]), pa.array(n.astype(np.int64))], names=names)


def count_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None, known_share: int = KNOWN_SHARE, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[doc_id].dataType.simpleString()
    row = F.struct(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("nth")).alias("row")
    read = docs.select(row, F.col(text).alias("text"))
    stored = word_pieces(read.select("text"), path, words_per_task)
    total = stored.agg(F.sum("n")).first()[0] or 0
    known = stored.where(F.col("n") * known_share >= total).select("h", "pieces").toArrow().sort_by("h")
    shared = docs.sparkSession.sparkContext.broadcast((known["h"].to_numpy(), known["pieces"].to_numpy()))
    fields = f"row struct<doc_id:{kind},nth:bigint>, n_pretokens bigint, n_tokens bigint, h bigint, n bigint"
    parts = materialise(read.mapInArrow(lambda batches: count_parts(batches, *shared.value), fields), "counts")
    rare = parts.where("h IS NOT NULL").select(F.col("row.nth").alias("of"), "h", F.col("n").alias("times"))
    more = rare.join(stored.select(F.col("h").alias("at"), "pieces"), F.col("h") == F.col("at")).groupBy("of").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    whole = parts.where("h IS NULL").join(more, F.col("row.nth") == F.col("of"), "left")
    return whole.select("row.doc_id", "n_pretokens", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
