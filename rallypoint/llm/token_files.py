"""Token-id shards under a minimal perfect hash index.

Documents are dealt to tasks by ranges of doc_id. Each task encodes its texts and
appends their ids, raw little-endian numbers of 16 bits where the vocabulary
allows it and else of 32, to one shard file; nothing but ids is in it. An index part holds the keys that a hash deals to it, in blocks
of about BLOCK_KEYS keys. A block is a minimal perfect hash function (levels of
bits, each of which one key alone has hit; a key's slot is the rank of its bit)
and an array of slots, each with the key's fingerprint, shard, offset and number
of ids. A key is found with three small range reads: directory, bits, slot.

A document's key is its doc_id and its number among the rows of that doc_id, so
a doc_id with very many rows spans shards and index parts like any other rows.

Only files that a finished task reported are ever read; what a lost task had
written stays unread. A shard and an index part have one row each in the lists
that Spark joins with.

Defined results for unusual input: a null or empty text is the end id alone; a
null doc_id is a key of its own and comes first; rows with equal doc_id follow one
another by their texts' hashes, whole repeats in the order of reading; strings
that name special tokens are ordinary text; very long texts are encoded whole; an
empty table has no shard and gives an empty result; a key that was never written
is found to be absent, but for one chance in 2**32; other columns, whatever their
names, are never read.
"""

from __future__ import annotations

import array
import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallypoint.llm.common import by_bytes, materialise, new_dir, partitions_for

END_ID = 0
#: Keys of an index part at most, on average; small tables get a part for each shuffle partition.
PART_KEYS = 1 << 20
BLOCK_KEYS = 4096
#: Bits of a level for each key that it gets.
LEVEL_ROOM = 2
#: Ids that one read of a shard takes, unless one document has more.
READ_IDS = 1 << 21
#: Encoded segments that a Python worker remembers, and as many again that it has used before these.
REMEMBERED = 300_000

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
#: White space of Unicode beyond these six; a text that holds one goes to the tokenizer whole.
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"
#: The vocabulary's splitter on ASCII without white space at the end.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")
_LATIN = "A-Za-z" + "".join(x for x in map(chr, range(0xC0, 0x180)) if x.isalpha())
_PLAIN = re.compile(rf" ?[!-~{_LATIN}]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+")


class SegmentIds:
    """Ids of text segments, exactly as the tokenizer gives them within the text.

    The splitter never lets a piece run from other characters into white space,
    so texts are cut before it; plain segments go to the model piece by piece,
    any other goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.tokenize = self.whole.model.tokenize
        spell = self.whole.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(x): spell(x)[0][0] for x in (chr(i) for i in range(0xC0, 0x180)) if x.isalpha()}
        self.letters[32] = spell(" ")[0][0]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces[piece] = array.array("I", [x.id for x in self.tokenize(piece.translate(self.letters))]).tobytes()
        return found

    def _segment(self, raw: bytes) -> bytes:
        text, known = raw.decode(), self.pieces
        if not _PLAIN.fullmatch(text):
            return self.encode(text)
        pieces = (_ASCII if text.isascii() else _PIECES).findall(text)
        if len(pieces) == 1:
            return array.array("I", [x.id for x in self.tokenize(text.translate(self.letters))]).tobytes()
        return b"".join([known.get(x) or self._piece(x) for x in pieces])

    def packed(self, segments: list[bytes]) -> list[bytes]:
        young, old, out = self.young, self.old, []
        for raw in segments:
            ids = young.get(raw)
            if ids is None:
                ids = young[raw] = old.get(raw) or self._segment(raw)
            out.append(ids)
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return out


@functools.cache
def segment_ids(path: str) -> SegmentIds:
    """One for all tasks of a Python worker."""
    return SegmentIds(path)


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of binary texts without nulls, flat, and how many each text has.

    A segment begins with each run of white space; the last of several
    characters of a run begins one too, and so does what follows a run that
    doesn't end in a space.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    whole = texts.buffers()[2] or pa.py_buffer(b"")
    raw = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    space = _SPACE[raw]
    after_space = np.zeros(len(raw), bool)
    after_space[1:] = space[:-1]
    after_space &= ~first[:-1]
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    begins = first.copy()
    begins[:-1] |= (space & ~after_space) | (last & after_space)
    begins[1:] |= last & (raw != 32)
    begins[-1] = False
    at = np.flatnonzero(begins[:-1]) if len(raw) else np.zeros(0, np.int64)
    bounds = pa.py_buffer(np.append(at, len(raw)).astype(np.int64) + offsets[0])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, bounds, whole])
    upto = np.searchsorted(at, ends)
    return flat, np.diff(upto)


def texts_ids(texts: pa.Array, known: SegmentIds) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts in turn: all ids in a row, each text's end id among them, and each text's number of ids."""
    end = array.array("I", [END_ID]).tobytes()
    for part in by_bytes(texts):
        part = pc.fill_null(part, b"")
        odd = pc.match_substring_regex(part.cast(pa.large_string()), _OTHER_SPACE)
        if pc.any(odd).as_py():
            packed = [known.encode(x.decode()) + end for x in part.to_pylist()]
            yield np.frombuffer(b"".join(packed), np.uint32), np.array([len(x) // 4 for x in packed])
            continue
        flat, counts = segments(part)
        coded = flat.dictionary_encode()
        packed = known.packed(coded.dictionary.to_pylist()) + [end]
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(packed) - 1)
        ends = np.cumsum([0, *map(len, packed)]) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(packed), np.uint32))).take(pa.array(words))
        by_text = lists.offsets.to_numpy()[np.concatenate(([0], np.cumsum(counts + 1)))]
        yield lists.values.to_numpy(), np.diff(by_text)


def _path(base: str, label: str) -> str:
    return f"{base}/{label}-{uuid.uuid4().hex}"


def id_type(vocabulary: str) -> str:
    """How ids stand in shards."""
    return "<u2" if segment_ids(vocabulary).whole.get_vocab_size() <= 1 << 16 else "<u4"


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Appends every row's ids to this task's shard; yields doc_id, its number within the shard's run of it, shard, file, offset, n_tokens."""
    known, shard = segment_ids(vocabulary), TaskContext.get().partitionId()
    store, base = FileSystem.from_uri(folder)
    out, path, at, last, run = None, _path(base, "ids"), 0, None, -1
    try:
        for batch in batches:
            if out is None and len(batch):
                out = store.open_output_stream(path, compression=None)
            counts = [np.zeros(0, np.int64)]
            for ids, n in texts_ids(batch.column(1), known):
                out.write(ids.astype(kind).tobytes())
                counts.append(n)
            n = np.concatenate(counts)
            numbers = []
            for key in batch.column(0).to_pylist():
                run = run + 1 if run >= 0 and key == last else 0
                last = key
                numbers.append(run)
            offsets = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [pa.array(numbers, pa.int64()), pa.array([shard] * len(n), pa.int32()), pa.array([path] * len(n), pa.string()), pa.array(offsets, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "run", "shard", "file", "offset", "n_tokens"])
    finally:
        if out is not None:
            out.close()


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Each key's hash for a level; keys are rows of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash function: levels of bits; a key's slot is the rank of the first bit that it alone has hit."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Raises ValueError if two keys are the same 128 bits."""
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == 64:
                raise ValueError("a key comes twice")
            size = -(-LEVEL_ROOM * len(left) // 8) * 8
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for some keys that were not among those the function was made of."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_, base = open_[~hit], base + size
        return out

    def dump(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}I", len(self.sizes), *self.sizes) + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        sizes = list(struct.unpack_from(f"<{n}I", raw, 4))
        return cls(sizes, np.unpackbits(np.frombuffer(raw, np.uint8, sum(sizes) // 8, 4 + 4 * n)).view(bool))


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


def key_text(doc_id: Column, number: Column) -> Column:
    return F.concat(F.when(doc_id.isNull(), "null").otherwise(F.concat(F.lit("="), doc_id.cast("string"))), F.lit(":"), number.cast("string"))


def key_hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each key; the first is Spark's xxhash64 of the text, unsigned."""
    raw = [x.encode() for x in keys]
    return np.array([[xxhash.xxh64_intdigest(x, 42) for x in raw], [xxhash.xxh64_intdigest(x, 43) for x in raw]], np.uint64).reshape(2, -1).T.copy()


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (hashes[:, 1] >> np.uint64(32)).astype(np.uint32)


def _block(hashes: np.ndarray, parts: int, blocks: int) -> np.ndarray:
    return (hashes[:, 0] // np.uint64(parts) % np.uint64(blocks)).astype(np.int64)


def part_bytes(hashes: np.ndarray, slots: np.ndarray, parts: int) -> bytes:
    """An index part: number of blocks, where each block and its slots begin, blocks."""
    blocks = partitions_for(len(hashes), BLOCK_KEYS)
    block = _block(hashes, parts, blocks)
    order = np.argsort(block, kind="stable")
    bounds = np.searchsorted(block[order], np.arange(blocks + 1))
    at, directory, body = 8 + 16 * blocks + 8, [], []
    for i in range(blocks):
        own = order[bounds[i] : bounds[i + 1]]
        function = PerfectHash.of(hashes[own])
        held = np.zeros(len(own), SLOT)
        held[function.slots(hashes[own])] = slots[own]
        bits, raw = function.dump(), held.tobytes()
        directory += [at, at + len(bits)]
        body += [bits, raw]
        at += len(bits) + len(raw)
    return struct.pack(f"<{2 * blocks + 2}Q", blocks, *directory, at) + b"".join(body)


def _found(hashes: np.ndarray, raw: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each key in an index part, and whether its fingerprint agrees."""
    (blocks,) = struct.unpack_from("<Q", raw)
    directory = struct.unpack_from(f"<{2 * blocks + 1}Q", raw, 8)
    block, out, hit = _block(hashes, parts, blocks), np.zeros(len(hashes), SLOT), np.zeros(len(hashes), bool)
    for i in np.unique(block).tolist():
        begin, middle, end = directory[2 * i : 2 * i + 3]
        own = np.flatnonzero(block == i)
        at = PerfectHash.load(raw[begin:middle]).slots(hashes[own])
        held = np.frombuffer(raw, SLOT, (end - middle) // SLOT.itemsize, middle)
        own, at = own[at >= 0], at[at >= 0]
        out[own] = held[at]
        hit[own] = held["fingerprint"][at] == _fingerprints(hashes[own])
    return out, hit


@dataclass
class TokenFiles:
    """shards: shard, file, first_id (ids in earlier shards), rows; index: part, file; keys: doc_id, number of every row."""

    folder: str
    parts: int
    id_type: str
    shards: DataFrame
    index: DataFrame
    keys: DataFrame


def _with_starts(entries: DataFrame) -> DataFrame:
    """One row per shard: shard, file, rows, first_id, and what its first run of a doc_id must add to its numbers."""
    ends = entries.groupBy("shard", "file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("ids"), F.min_by(F.struct("doc_id"), "offset").alias("first"),
        F.max_by(F.struct("doc_id"), "offset").alias("last"), (F.max_by("run", "offset") + 1).alias("last_run"),
    )
    same_last = Window.partitionBy("last").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    by_shard = Window.orderBy("shard")
    before = by_shard.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("upto", F.sum("last_run").over(same_last))
    carried = F.when(F.lag("last").over(by_shard) == F.col("first"), F.lag("upto").over(by_shard)).otherwise(0)
    return ends.select("shard", "file", "rows", "first", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first_id"), carried.alias("carried"))


def write(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> TokenFiles:
    """Encodes all documents in ascending doc_id order into shards and indexes them."""
    spark, path = docs.sparkSession, vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    folder = new_dir(spark, "token-files")
    store, base = FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own, kind = docs.schema[doc_id].dataType.simpleString(), id_type(path)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_first("doc_id"), F.asc("_text"), F.asc("_row")]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    fields = f"doc_id {own}, run bigint, shard int, file string, offset bigint, n_tokens bigint"
    entries = materialise(dealt.mapInArrow(lambda batches: write_shard(batches, folder, path, kind), fields), "entries")
    shards = materialise(_with_starts(entries), "shards")
    carried = shards.where("carried > 0").select(F.col("shard").alias("_shard"), F.col("first.doc_id").alias("_first"), "carried")
    met = entries.join(carried, (F.col("shard") == F.col("_shard")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    numbered = met.select("doc_id", (F.col("run") + F.coalesce("carried", F.lit(0))).alias("number"), "shard", "offset", "n_tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partitions_for(entries.count(), PART_KEYS))
    keyed = numbered.withColumn("key", key_text(F.col("doc_id"), F.col("number"))).select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "shard", "offset", "n_tokens")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        hashes = key_hashes(rows.key.tolist())
        slots = np.zeros(len(rows), SLOT)
        slots["fingerprint"], slots["shard"], slots["offset"], slots["n"] = _fingerprints(hashes), rows["shard"], rows.offset, rows.n_tokens
        store, base = FileSystem.from_uri(folder)
        file = _path(base, "index")
        with store.open_output_stream(file, compression=None) as out:
            out.write(part_bytes(hashes, slots, parts))
        return pd.DataFrame({"part": rows.part.iloc[:1], "file": [file]})

    index = materialise(keyed.groupBy("part").applyInPandas(build, "part bigint, file string"), "index")
    return TokenFiles(folder, parts, kind, shards.select("shard", "file", "rows", "first_id"), index, numbered.select("doc_id", "number"))


def look_up(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, number, shard, offset, n_tokens of each key (doc_id, number); nulls for a key that was never written.

    Equal keys are looked up once.
    """
    folder, parts = files.folder, files.parts
    kinds = [keys.schema[c].dataType.simpleString() for c in ("doc_id", "number")]
    asked = keys.select("doc_id", "number", key_text(F.col("doc_id"), F.col("number")).alias("key")).dropDuplicates(["key"])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).join(files.index, "part", "left")

    def look(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["doc_id", "number"]].copy()
        slots, hit = np.zeros(len(rows), SLOT), np.zeros(len(rows), bool)
        if file := rows.file.iloc[0]:
            store, _ = FileSystem.from_uri(folder)
            with store.open_input_stream(file, compression=None) as f:
                slots, hit = _found(key_hashes(rows.key.tolist()), f.read(), parts)
        for name, field in (("shard", "shard"), ("offset", "offset"), ("n_tokens", "n")):
            out[name] = pd.array(slots[field].astype(np.int64), "Int64")
            out.loc[~hit, name] = pd.NA
        return out

    return asked.groupBy("part").applyInPandas(look, f"doc_id {kinds[0]}, number {kinds[1]}, shard int, offset bigint, n_tokens bigint")


def read_ids(batches: Iterator[pa.RecordBatch], folder: str, kind: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Reads each row's range of its shard, neighbours together; adds ids_crc32 and, if asked for, ids."""
    size = np.dtype(kind).itemsize
    store, _ = FileSystem.from_uri(folder)
    for batch in batches:
        files, offsets, counts = (batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))
        crcs, ids, i = [], [], 0
        while i < len(files):
            j, begin = i, offsets[i]
            end = begin + counts[i]
            while j + 1 < len(files) and files[j + 1] == files[i] and offsets[j + 1] == end and end + counts[j + 1] - begin <= READ_IDS:
                j += 1
                end += counts[j]
            with store.open_input_file(files[i]) as f:
                held = np.frombuffer(f.read_at(size * (end - begin), size * begin), kind)
            for k in range(i, j + 1):
                own = held[offsets[k] - begin : offsets[k] - begin + counts[k]]
                if len(own) != counts[k]:
                    raise ValueError(f"{files[k]} ends before id {offsets[k] + counts[k]}")
                crcs.append(zlib.crc32(own.astype("<u4")))
                if keep_ids:
                    ids.append(own.astype(np.int64))
            i = j + 1
        columns = [batch.column(c) for c in ("doc_id", "number", "start", "n_tokens")] + [pa.array(crcs, pa.int64())]
        names = ["doc_id", "number", "start", "n_tokens", "ids_crc32"]
        if keep_ids:
            columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def read(files: TokenFiles, keys: DataFrame | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, number, start, n_tokens, ids_crc32 (and ids) of the written documents with these keys, all by default, through the index."""
    folder, kind, found = files.folder, files.id_type, look_up(files, files.keys if keys is None else keys).where(F.col("shard").isNotNull())
    kinds = [found.schema[c].dataType.simpleString() for c in ("doc_id", "number")]
    placed = found.join(files.shards, "shard").withColumn("start", F.col("first_id") + F.col("offset"))
    dealt = placed.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").select("doc_id", "number", "file", "offset", "n_tokens", "start")
    fields = f"doc_id {kinds[0]}, number {kinds[1]}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    return dealt.mapInArrow(lambda batches: read_ids(batches, folder, kind, keep_ids), fields)


class KeyedIds:
    """One document at a time, by its key: range reads of an index part's directory, bits and slot, then of a shard.

    index maps a part to its file and shards a shard to its file, as in the lists of TokenFiles.
    """

    def __init__(self, files: TokenFiles, index: dict[int, str], shards: dict[int, str]) -> None:
        self.store, _ = FileSystem.from_uri(files.folder)
        self.parts, self.kind, self.index, self.shards = files.parts, np.dtype(files.id_type), index, shards

    def get(self, key: str) -> np.ndarray | None:
        """The ids of the key (as key_text writes it), or None."""
        hashes = key_hashes([key])
        signed = int(hashes[0, 0].astype(np.int64))
        if (path := self.index.get(signed % self.parts)) is None:
            return None
        with self.store.open_input_file(path) as f:
            (blocks,) = struct.unpack("<Q", f.read_at(8, 0))
            block = int(_block(hashes, self.parts, blocks)[0])
            begin, middle, _ = struct.unpack("<3Q", f.read_at(24, 8 + 16 * block))
            at = int(PerfectHash.load(f.read_at(middle - begin, begin)).slots(hashes)[0])
            if at < 0:
                return None
            slot = np.frombuffer(f.read_at(SLOT.itemsize, middle + at * SLOT.itemsize), SLOT)[0]
        if slot["fingerprint"] != _fingerprints(hashes)[0]:
            return None
        with self.store.open_input_file(self.shards[int(slot["shard"])]) as f:
            size = self.kind.itemsize
            return np.frombuffer(f.read_at(size * int(slot["n"]), size * int(slot["offset"])), self.kind)


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Writes all documents and reads them back through the index: doc_id, start, n_tokens, ids_crc32."""
    return read(write(docs, text, doc_id, vocabulary)).drop("number")
