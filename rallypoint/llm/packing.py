"""Best-fit packing of tokenised documents with a bounded number of open bins.

Documents are tokenised where they are read; only small piece rows travel from
there. They are dealt to packing tasks in turn and arrive there in the order of
a hash, so that a task that runs again sees the same order; nothing is sorted by
length. Each task places its pieces as they come: a bitset keyed by free space
finds the open bin that a piece fills best, and when the fixed number of bins is
open the fullest closes first. Sequences never cross tasks.

Defined results for unusual input: a null or empty text is the single end id; a
document longer than a sequence is cut, and only its last piece may be short;
very long texts are tokenised whole; bins with equal space are filled newest
first; repeated rows are packed each for itself; a null doc_id stays null; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import array
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallypoint.llm.common import by_bytes, materialise, partitions_for, tokens

SEQUENCE = 2048
OPEN_BINS = 64
END_ID = 0
#: Pieces that one packing task gets on average; a task leaves at most OPEN_BINS sequences open at its end.
PIECES_PER_TASK = 1 << 16
#: Distinct words whose ids a Python worker remembers from task to task.
REMEMBERED = 250_000

#: Lower-case letters that normalisation leaves as they are.
_LETTERS = "a-z" + "".join(x for x in map(chr, range(0xC0, 0x180)) if x.isalpha() and x.lower() == x)
#: What the vocabulary's splitter makes of such words.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~×÷]+")
#: Words that normalisation only lower-cases, letter by letter.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")


class WordIds:
    """Token ids of single words, as the tokenizer gives them within any text.

    The vocabulary's splitter never joins text across white space, so a text's
    ids are those of its words in turn. Plain words go to the model piece by
    piece; a word with any other character goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        letters = (chr(x) for x in range(0xC0, 0x180))
        self.bytes = {ord(x): self.whole.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in letters}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.translate(self.bytes)
        found = self.pieces[piece] = array.array("I", [x.id for x in self.tokenize(raw)]).tobytes()
        return found

    def _ids(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return array.array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        known = self.pieces
        return b"".join([known.get(x) or self._piece(x) for x in _PIECES.findall(word.lower())])

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as 32-bit numbers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
            self.pieces.clear()
        known, out = self.words, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._ids(word.decode())
            out.append(ids)
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def texts_ids(texts: pa.Array, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each text has (no end ids)."""
    words, n_words = tokens(texts)
    coded = words.dictionary_encode()
    packed = known.packed(coded.dictionary.cast(pa.large_binary()).to_pylist())
    ends = np.cumsum([0, *map(len, packed)]) // 4
    vocabulary = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(packed), np.uint32)))
    lists = vocabulary.take(coded.indices)
    by_text = lists.offsets.to_numpy()[np.concatenate(([0], np.cumsum(n_words)))]
    return lists.values.to_numpy(), np.diff(by_text)


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    known = word_ids(path)
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column(1)):
            ids, counts = texts_ids(texts, known)
            row, piece, start, length, crc = (array.array("q") for _ in range(5))
            at = 0
            for i, n in enumerate(counts.tolist()):
                raw = ids[at : at + n].tobytes() + end
                at += n
                for k, a in enumerate(range(0, n + 1, most)):
                    b = min(a + most, n + 1)
                    row.append(done + i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            done += len(texts)
            owners = batch.column(0).take(pa.array(np.frombuffer(row, np.int64)))
            columns = [pa.array(np.frombuffer(x, np.int64)) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays([owners, pa.array(np.frombuffer(piece, np.int64).astype(np.int32)), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])


class OpenBins:
    """Best fit among at most `most` open bins; stacks of bins keyed by free space in a bitset."""

    def __init__(self, size: int, most: int, first: int = 0) -> None:
        self.size, self.most = size, most
        self.spaces = 0
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]
        self.n_open, self.next, self.closed = 0, first, 0

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        found = stack.pop()
        if not stack:
            self.spaces ^= 1 << space
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it that a piece of this length gets."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.size, self.next
            self.next += 1
            if self.n_open >= self.most and length < self.size:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.closed += 1
        if left := space - length:
            if not self.stacks[left]:
                self.spaces |= 1 << left
            self.stacks[left].append(found)
            self.n_open += 1
        return found, self.size - space


def place_pieces(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(size, most, TaskContext.get().partitionId() << 40)
    for batch in batches:
        placed = np.array([bins.place(x) for x in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0].copy()), pa.array(placed[:, 1].copy())], names=[*batch.schema.names, "sequence_id", "offset"])


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None,
    size: int = SEQUENCE, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = materialise(read.mapInArrow(lambda batches: cut_pieces(batches, path, size), fields), "pieces")
    arrival = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = pieces.repartition(partitions_for(pieces.count(), pieces_per_task)).withColumn("arrival", arrival).sortWithinPartitions("arrival", "doc_id", "piece").drop("arrival")
    return dealt.mapInArrow(lambda batches: place_pieces(batches, size, open_bins), fields + ", sequence_id bigint, offset bigint")
