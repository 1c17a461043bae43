"""Brown class-based bigram model: exchange clustering, transitions, emissions.

Spark counts every training word. The CORE_WORDS most frequent ones are moved
between classes by exchange: a sweep moves each to the class where the class bigram
likelihood gains most (the words of a part one after the other, parts side by
side), and sweeps go on while the likelihood still grows. Every other training
word then gets the class that its own neighbours among the core words favour, by
the same gain. So each training word has a class from its own bigrams, and
counts, classes of words and transitions grow with the corpus; only the list of
core words and the class table have a fixed size.

A text's probability is, token by token, class given class times word given
class. Both are smoothed and sum to one, with one place per class kept for
unseen words; an unseen word's class is summed over, and what follows it is
drawn from the class frequencies.

Counts and classes of all words stay a distributed table. Words holding at least
1/KNOWN_SHARE of the tokens (so at most KNOWN_SHARE of them) travel to the tasks;
the other words of a text meet that table in a join.

Defined results for unusual input: a null or empty text is the end token alone;
a null doc_id counts as empty text, hence held out; repeated rows are scored one
by one; a very long text is scored whole; ties between classes go to the lower
class; a corpus without training rows scores every word as unseen; an empty
table gives an empty result; other columns, whatever their names, are never
read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rallypoint.llm.common import by_bytes, materialise, partitions_for, release_memory, tokens

CLASSES = 64
#: Exchange moves every word with at least this part of the training tokens, so fewer words than this; all others are placed beside them.
CORE_SHARE = 1 << 17
#: Core words in a part; the words of a part move one after the other, parts side by side.
PART_WORDS = 512
#: Sweeps go on while the likelihood grows by more than this share of itself.
LEAST_GAIN = 1e-4
#: Training tokens behind the words that one task places on average.
TOKENS_PER_TASK = 1 << 21
#: Entries that a task gathers before it merges equal ones.
HELD = 1 << 22
KNOWN_SHARE = 1 << 22
ADD = 0.1
#: Weight of the class frequencies in a class's transitions.
PRIOR = 1.0


def _hash(word: bytes) -> int:
    return xxh64_intdigest(word) - (1 << 63)


#: No word holds a line end.
END = _hash(b"\n")


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all lower-cased words, the hashes they stand for, and words per text."""
    lower = pc.ascii_lower(texts.cast(pa.large_string()))
    words, n_words = tokens(lower.cast(pa.large_binary()))
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(_hash, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashes, n_words


def _look_up(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the hash is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def _bounds(kinds: np.ndarray, n_words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's kind and its predecessor's, an end token behind every text."""
    then = np.insert(kinds, np.cumsum(n_words), end)
    before = np.empty_like(then)
    before[:1] = end
    before[1:] = then[:-1]
    return before, then


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in by_bytes(batch.column("text")):
            codes, hashes, n_words = _coded(texts)
            found = np.bincount(codes, minlength=len(hashes)) if len(hashes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, END)), pa.array(np.append(found, len(n_words)).astype(np.int64))], names=["h", "n"])


def count_core(batches: Iterator[pa.RecordBatch], core: np.ndarray) -> Iterator[pa.RecordBatch]:
    """pair, n: bigrams of core words (sorted hashes; the end token has the number behind them)."""
    release_memory()
    size = len(core) + 1
    keys, counts, held = [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0].astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        for texts in by_bytes(batch.column("text")):
            codes, hashes, n_words = _coded(texts)
            at, known = _look_up(core, hashes)
            before, then = _bounds(np.where(known, at, -1)[codes], n_words, len(core))
            both = (before >= 0) & (then >= 0)
            key, n = np.unique(before[both] * size + then[both], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                merged = _merge(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > HELD // 2:
                    yield out()
                    keys, counts, held = [], [], 0
    if keys:
        merged = _merge(keys, counts)
        keys, counts = [merged[0]], [merged[1]]
        yield out()


def pack_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of arrays for the rows own, other, side, n of a part."""
    release_memory()
    got = [batch for batch in batches if batch.num_rows]
    if got:
        rows = pa.Table.from_batches(got).sort_by([("own", "ascending"), ("side", "ascending"), ("other", "ascending")])
        blobs = [pa.array([rows[c].to_numpy().astype(kind).tobytes()], pa.large_binary()) for c, kind in (("own", "<i4"), ("other", "<i4"), ("side", "i1"), ("n", "<i8"))]
        yield pa.RecordBatch.from_arrays(blobs, names=["own", "other", "side", "n"])


PACKED = "own binary, other binary, side binary, n binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("own", "<i4"), ("other", "<i4"), ("side", "i1"), ("n", "<i8")))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(table: np.ndarray) -> float:
    """The part of the class bigram log likelihood that depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def class_pairs(batches: Iterator[pa.RecordBatch], own_class: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """cell, n: class bigrams of a part's words, from their successors."""
    release_memory()
    for own, other, side, n in _unpacked(batches):
        right = side == 0
        found = np.bincount(own_class[own[right]] * classes + own_class[other[right]], n[right].astype(float), classes * classes)
        cells = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(found[cells].astype(np.int64))], names=["cell", "n"])


def gains(table: np.ndarray, r: np.ndarray, l: np.ndarray, self_n: float) -> np.ndarray:  # noqa: E741
    """What the likelihood gains by adding a word to each class, up to one constant.

    r and l count the word's successors and predecessors by class, without self_n
    bigrams of the word with itself; table doesn't hold the word.
    """
    to, of = np.flatnonzero(r), np.flatnonzero(l)
    gain = (_f(table[:, to] + r[to]) - _f(table[:, to])).sum(1) + (_f(table[of] + l[of, None]) - _f(table[of])).sum(0)
    diag = table.diagonal()
    gain += _f(diag + r + l + self_n) - _f(diag + r) - _f(diag + l) + _f(diag)
    rows, columns = table.sum(1) + l, table.sum(0) + r
    return gain - (_f(rows + r.sum() + self_n) - _f(rows) + _f(columns + l.sum() + self_n) - _f(columns))


def move_part(batches: Iterator[pa.RecordBatch], own_class: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, word, class of a part's words after one sweep over them, the most frequent first.

    Every move is taken at once into the class table and into the neighbours'
    class counts of the part's own words, so both stay what a recount would give
    with the other parts' words where they were, and each move gains likelihood.
    The last word is the end token and keeps the last class to itself.
    """
    release_memory()
    classes = len(table)
    for own, other, side, n in _unpacked(batches):
        table = table.astype(float)
        words, local = np.unique(own, return_inverse=True)
        alone = own == other
        vectors = np.zeros((2, len(words), classes))
        np.add.at(vectors, (side[~alone], local[~alone], own_class[other[~alone]]), n[~alone])
        selves = np.bincount(local[alone & (side == 0)], n[alone & (side == 0)].astype(float), len(words))
        weight = vectors.sum((0, 2)) + 2 * selves
        found = own_class[words].copy()
        inside = np.flatnonzero(np.isin(other, words) & ~alone)
        at = np.searchsorted(words, other[inside])
        order = inside[np.argsort(at, kind="stable")]
        bounds = np.searchsorted(np.sort(at), np.arange(len(words) + 1))
        near_side, near_word, near_n = side[order], local[order], n[order].astype(float)
        for i in np.argsort(-weight, kind="stable").tolist():
            if words[i] == len(own_class) - 1:
                continue
            r, l, s, a = vectors[0, i], vectors[1, i], selves[i], found[i]  # noqa: E741
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= s
            gain = gains(table, r, l, s)[: classes - 1]
            b = int(np.argmax(gain))
            b = a if gain[b] <= gain[a] + 1e-6 else b
            table[b] += r
            table[:, b] += l
            table[b, b] += s
            found[i] = b
            if a != b:
                mine = slice(bounds[i], bounds[i + 1])
                np.add.at(vectors, (near_side[mine], near_word[mine], a), -near_n[mine])
                np.add.at(vectors, (near_side[mine], near_word[mine], b), near_n[mine])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), words[0], np.int64)), pa.array(words.astype(np.int64)), pa.array(found.astype(np.int64))], names=["part", "word", "class"])


def exchange(core: DataFrame, own_class: np.ndarray, classes: int, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the core words (the end token last) and their class bigrams; core as pack_core gives it.

    Starts from own_class. The driver holds the classes and one classes-by-classes
    table. Parts move side by side; a sweep takes all parts' moves if the recounted
    likelihood rises, else those of half of the parts, and so on down to one part's,
    which can't lose. Ends when a sweep gains no more than least_gain of the
    likelihood, or nothing moves; so no sweep ever loses.
    """

    def table_of(own_class: np.ndarray) -> np.ndarray:
        cells = core.mapInArrow(lambda b: class_pairs(b, own_class, classes), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(classes * classes)
        out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return out.reshape(classes, classes)

    table = table_of(own_class)
    while True:
        moved = core.mapInArrow(lambda b: move_part(b, own_class, table), "part bigint, word bigint, class bigint").toArrow()  # noqa: B023
        part, word, to = (moved[c].to_numpy() for c in ("part", "word", "class"))
        changed = own_class[word] != to
        part, word, to = part[changed], word[changed], to[changed]
        tried, every = np.unique(part), True
        while len(tried):
            taken = np.isin(part, tried)
            then = own_class.copy()
            then[word[taken]] = to[taken]
            new = table_of(then)
            gain = likelihood(new) - likelihood(table)
            if gain > 0 or len(tried) == 1:
                break
            tried, every = tried[: len(tried) // 2], False
        if not len(tried) or gain <= 0:
            return own_class, table
        enough = gain > least_gain * abs(likelihood(table))
        own_class, table = then, new
        if every and not enough:
            return own_class, table


@dataclass
class Core:
    """Sorted hashes of the core words and their classes."""

    hashes: np.ndarray
    own_class: np.ndarray
    table: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.table)


OTHERS = "bucket int, what string, a binary, b binary, n binary"


def _blobs(bucket: np.ndarray, what: str, a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row of arrays for each bucket."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
    cut = [x for x in zip(range(buckets), [0, *ends[:-1]], ends, strict=True) if x[1] < x[2]]
    columns = [pa.array([x[order[i:j]].tobytes() for _, i, j in cut], pa.binary()) for x in (a.astype("<i8"), b.astype("<i8"), n.astype("<i4"))]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([what] * len(cut), pa.string()), *columns], names=["bucket", "what", "a", "b", "n"])


def count_others(batches: Iterator[pa.RecordBatch], core: Core, buckets: int) -> Iterator[pa.RecordBatch]:
    """What training texts tell of words outside the core, by buckets of their hashes.

    `near` rows hold a word, its neighbour's class (successors; behind them
    predecessors; last the word itself, once a token) and a count; `pair` rows a
    word, its successor outside the core, and a count.
    """
    release_memory()
    codes_each = 2 * core.classes + 1
    for batch in batches:
        for texts in by_bytes(batch.column("text")):
            codes, hashes, n_words = _coded(texts)
            at, known = _look_up(core.hashes, hashes)
            end = len(hashes)
            before, then = _bounds(codes, n_words, end)
            kind = np.append(np.where(known, core.own_class[at] if len(core.hashes) else 0, -1), core.own_class[-1])
            a, b = kind[before], kind[then]
            parts = [(then[b < 0], 2 * core.classes), (before[(a < 0) & (b >= 0)], b[(a < 0) & (b >= 0)]), (then[(b < 0) & (a >= 0)], core.classes + a[(b < 0) & (a >= 0)])]
            key, n = np.unique(np.concatenate([w * codes_each + c for w, c in parts]), return_counts=True)
            yield _blobs(_bucket(hashes[key // codes_each], buckets), "near", hashes[key // codes_each], key % codes_each, n, buckets)
            both = (a < 0) & (b < 0)
            key, n = np.unique(before[both] * (end + 1) + then[both], return_counts=True)
            first = hashes[key // (end + 1)]
            yield _blobs(_bucket(first, buckets), "pair", first, hashes[key % (end + 1)], n, buckets)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _merge_pairs(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    a, b, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(n.astype(np.int64), first) if len(first) else n.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], *whats: str) -> dict[str, tuple[np.ndarray, ...]]:
    held: dict[str, list[tuple[np.ndarray, ...]]] = {w: [] for w in whats}
    sizes = dict.fromkeys(whats, 0)
    for batch in batches:
        for i, what in enumerate(batch.column("what").to_pylist()):
            a, b, n = (batch.column(c)[i].as_buffer() for c in ("a", "b", "n"))
            held[what].append((np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(n, "<i4").astype(np.int64)))
            sizes[what] += len(held[what][-1][0])
            if sizes[what] > HELD:
                held[what] = [_merge_pairs(held[what])]
                # The next merge waits until as much has come again.
                sizes[what] = 0
    return {w: _merge_pairs(x) for w, x in held.items()}


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, n_words: int, table: np.ndarray) -> np.ndarray:
    """The class of each word (numbers from 0, in order) that gains most; the end token's class is no choice."""
    classes = len(table)
    near = np.zeros((2, n_words, classes))
    inner = code < 2 * classes
    np.add.at(near, (code[inner] // classes, word[inner], code[inner] % classes), n[inner])
    totals = np.bincount(word[~inner], n[~inner].astype(float), n_words)[:, None]
    gain = np.zeros((n_words, classes))
    now = _f(table)
    for side, (cells, filled) in enumerate(((table, now), (table.T, now.T))):
        w, c = np.nonzero(near[side])
        for i in range(0, len(w), 1 << 14):
            ws, cs = w[i : i + (1 << 14)], c[i : i + (1 << 14)]
            more = _f(cells[:, cs].T + near[side][ws, cs][:, None]) - filled[:, cs].T
            first = np.flatnonzero(np.append(True, ws[1:] != ws[:-1]))
            gain[ws[first]] += np.add.reduceat(more, first)
    diag, r, l = table.diagonal(), near[0], near[1]  # noqa: E741
    gain += _f(diag + r + l) - _f(diag + r) - _f(diag + l) + _f(diag)
    for sums in (table.sum(0) + r, table.sum(1) + l):
        gain -= _f(sums + totals) - _f(sums)
    return np.argmax(gain[:, : max(1, classes - 1)], axis=1)


PLACED = OTHERS + ", h bigint, count bigint, class int"


def place_others(batches: Iterator[pa.RecordBatch], core: Core, buckets: int) -> Iterator[pa.RecordBatch]:
    """The class of each word of a bucket (h, count, class), and what the class bigrams still need.

    `cell` rows count class bigrams with core words; `class` rows hold a bucket's
    words and classes, `then` rows its successors outside the core and the class before them.
    """
    release_memory()
    got = _gathered(batches, "near", "pair")
    hashes, code, n = got["near"]
    words, local = np.unique(hashes, return_inverse=True)
    found = np.zeros(len(words), np.int64)
    ends = np.searchsorted(local, np.arange(0, len(words) + 4096, 4096)).tolist()
    for i, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        low = i * 4096
        found[low : low + 4096] = best_classes(local[x:y] - low, code[x:y], n[x:y], min(4096, len(words) - low), core.table)
    count = np.zeros(len(words), np.int64)
    whole = code == 2 * core.classes
    count[local[whole]] = n[whole]
    nulls = lambda k: [pa.nulls(k, t) for t in (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())]
    names = ["bucket", "what", "a", "b", "n", "h", "count", "class"]
    for i in range(0, len(words), 1 << 16):
        cut = slice(i, i + (1 << 16))
        columns = [pa.array(words[cut]), pa.array(count[cut]), pa.array(found[cut].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*nulls(len(words[cut])), *columns], names=names)
    own, other = found[local], code % core.classes
    right = code < core.classes
    left = (code >= core.classes) & ~whole
    cells = np.bincount(own[right] * core.classes + other[right], n[right].astype(float), core.classes**2)
    cells += np.bincount(other[left] * core.classes + own[left], n[left].astype(float), core.classes**2)
    at = np.flatnonzero(cells)
    first, second, m = got["pair"]
    spots, n_pairs = _merge_pairs([(second, found[_look_up(words, first)[0]], m)]), len(first)
    out = [_blobs(_bucket(words, buckets), "class", words, found, np.ones(len(words), np.int64), buckets)]
    if n_pairs:
        out.append(_blobs(_bucket(spots[0], buckets), "then", *spots, buckets))
    for x in out:
        yield pa.RecordBatch.from_arrays([*x.columns, *(pa.nulls(x.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=names)
    kind, none = pa.array(["cell"] * len(at), pa.string()), [pa.nulls(len(at), pa.binary())] * 3
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int32()), kind, *none, pa.array(at), pa.array(cells[at].astype(np.int64)), pa.nulls(len(at), pa.int32())], names=names)


def pair_cells(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """cell, n: class bigrams of a bucket's words behind words outside the core."""
    release_memory()
    got = _gathered(batches, "class", "then")
    words, own, _ = got["class"]
    then, before, n = got["then"]
    if len(then):
        cells = np.bincount(before * classes + own[_look_up(words, then)[0]], n.astype(float), classes * classes)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], names=["cell", "n"])


@dataclass
class Model:
    """Known words' sorted hashes, counts and classes; log10 of transitions and of class sizes.

    Class number `classes` stands for an unseen word.
    """

    known: np.ndarray
    counts: np.ndarray
    own_class: np.ndarray
    step: np.ndarray
    size: np.ndarray
    tokens: int
    distinct: int
    end_count: int

    @property
    def classes(self) -> int:
        return len(self.size)


def class_words(docs: DataFrame, classes: int = CLASSES, core_words: int | None = None, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, np.ndarray, int]:
    """h, n, class of every training word (the end token too), the class bigrams, and how many words are core.

    The core is every word with at least 1 / CORE_SHARE of the tokens, or the core_words most frequent words if asked for.
    """
    counts = docs.mapInArrow(count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.col("h") != END)
    top = top.where(F.col("n") * CORE_SHARE >= total) if core_words is None else top.orderBy(F.desc("n"), "h").limit(core_words)
    top = top.toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    hashes, own_n = top["h"].to_numpy(), top["n"].to_numpy()
    by_hash = np.argsort(hashes)
    core_hashes = hashes[by_hash]
    size = len(core_hashes) + 1
    pairs = docs.mapInArrow(lambda b: count_core(b, core_hashes), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.select(F.expr(f"CAST(pair DIV {size} AS INT)").alias("own"), F.expr(f"CAST(pair % {size} AS INT)").alias("other"), "n"), "pairs")
    both = pairs.withColumn("side", F.lit(0)).union(pairs.select(F.col("other").alias("own"), F.col("own").alias("other"), "n", F.lit(1).alias("side")))
    parts = partitions_for(size, PART_WORDS)
    packed = materialise(both.repartitionById(parts, F.col("own") % parts).mapInArrow(pack_core, PACKED), "core")
    ranks = np.append(by_hash % max(1, classes - 1), classes - 1)
    own_class, table = exchange(packed, ranks, classes, least_gain)
    core = Core(core_hashes, own_class, table)
    buckets = partitions_for(total, TOKENS_PER_TASK)
    others = docs.mapInArrow(lambda b: count_others(b, core, buckets), OTHERS)
    placed = materialise(others.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda b: place_others(b, core, buckets), PLACED), "placed")
    behind = placed.where("what IN ('class', 'then')").select("bucket", "what", "a", "b", "n").repartitionById(buckets, F.col("bucket"))
    rest = behind.mapInArrow(lambda b: pair_cells(b, classes), "cell bigint, n bigint").union(placed.where("what = 'cell'").select("h", "count"))
    rest = rest.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = table.copy()
    cells.reshape(-1)[rest["cell"].to_numpy()] += rest["n"].to_numpy()
    spark = docs.sparkSession
    end = counts.where(F.col("h") == END).select("h", "n", F.lit(classes - 1).alias("class"))
    mine = pa.table({"h": core_hashes, "n": own_n[by_hash], "class": own_class[:-1].astype(np.int32)})
    words = placed.where("what IS NULL").select("h", F.col("count").alias("n"), "class").union(end).union(spark.createDataFrame(mine))
    return words, cells, size - 1


def fit(docs: DataFrame, classes: int = CLASSES, core_words: int | None = None, known_share: int = KNOWN_SHARE) -> tuple[Model, DataFrame]:
    """The model of docs (column text), and the table h, n, class of all words."""
    words, cells, _ = class_words(docs, classes, core_words)
    words = materialise(words, "classes")
    sums = {r["class"]: (r.n, r.v) for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    by_class = np.array([sums.get(k, (0, 0)) for k in range(classes)], float)
    by_class[classes - 1, 1] = 1
    total, distinct = int(by_class[:, 0].sum()), sum(v for _, v in sums.values())
    known = words.where((F.col("n") * known_share >= total) & (F.col("h") != END)).toArrow().sort_by("h")
    end_count = int(sums.get(classes - 1, (0, 0))[0])
    share = (by_class[:, 0] + ADD) / (total + ADD * classes)
    size = by_class[:, 0] + ADD * (by_class[:, 1] + 1)
    step = np.empty((classes + 1, classes + 1))
    step[:-1, :-1] = (cells + PRIOR * share) / (cells.sum(1, keepdims=True) + PRIOR)
    step[-1, :-1] = share
    step[:, -1] = step[:, :-1] @ (ADD / size)
    return Model(known["h"].to_numpy(), known["n"].to_numpy(), known["class"].to_numpy(), np.log10(step), np.log10(size), total, distinct, end_count), words


PARTS = "n_tokens bigint, n_known bigint, base double, score double, h bigint, h2 bigint, before int, then int, n bigint"


def score_parts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Per text a row of sums over what known words tell, and rows for its other words.

    These are, each with a number n of occurrences: a word h with its neighbours'
    classes (before, then; -1 where the neighbour isn't known either), and two
    such words h, h2 in a row.
    """
    release_memory()
    end_class, unknown = model.classes - 1, -1
    end_base = np.log10(model.end_count + ADD)
    end_emit = end_base - model.size[end_class]
    names = ["row", *(x.split()[0] for x in PARTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        done = 0
        for texts in by_bytes(batch.column("text")):
            rows = batch.column("row").slice(done, len(texts))
            done += len(texts)
            n = len(texts)
            codes, hashes, n_words = _coded(texts)
            at, known = _look_up(model.known, hashes)
            word_base = np.where(known, np.log10(model.counts[at] + ADD), 0.0) if len(model.known) else np.zeros(len(hashes))
            word_class = np.where(known, model.own_class[at], unknown) if len(model.known) else np.full(len(hashes), unknown)
            emit = np.append(np.where(known, word_base - model.size[word_class], 0.0), end_emit)
            kind = np.append(word_class, end_class)
            end = len(hashes)
            before, then = _bounds(codes, n_words, end)
            a, b = kind[before], kind[then]
            doc = np.repeat(np.arange(n), n_words + 1)
            score = np.bincount(doc, np.where((a >= 0) & (b >= 0), model.step[a, b], 0.0) + emit[then], n)
            base = np.bincount(doc, np.append(word_base, end_base)[then], n)
            n_known = np.bincount(doc, (b >= 0) & (then != end), n).astype(np.int64) + int(model.end_count > 0)
            sums = [pa.array((n_words + 1).astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([rows, *sums, *(pa.nulls(n, k) for k in kinds[4:])], names=names)
            # A text's first token follows the end class; a word's successor stands in the same text, at least as its end.
            rare = np.flatnonzero(b < 0)
            span = model.classes + 1
            around = (a[rare] + 1) * span + b[rare + 1] + 1
            order = np.lexsort((around, then[rare], doc[rare]))
            keys = [x[order] for x in (doc[rare], then[rare], around)]
            which, word, near, m = _runs(keys)
            found = [pa.array(hashes[word]), pa.nulls(len(m), pa.int64()), pa.array((near // span - 1).astype(np.int32)), pa.array((near % span - 1).astype(np.int32)), pa.array(m)]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(which)), *(pa.nulls(len(m), k) for k in kinds[:4]), *found], names=names)
            both = np.flatnonzero((a < 0) & (b < 0))
            order = np.lexsort((then[both], before[both], doc[both]))
            which, first, second, m = _runs([x[order] for x in (doc[both], before[both], then[both])])
            found = [pa.array(hashes[first]), pa.array(hashes[second]), pa.nulls(len(m), pa.int32()), pa.nulls(len(m), pa.int32()), pa.array(m)]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(which)), *(pa.nulls(len(m), k) for k in kinds[:4]), *found], names=names)


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct rows of sorted key columns and how often each occurs."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return (*(k[first] for k in keys), np.diff(np.append(first, n)).astype(np.int64))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", classes: int = CLASSES, core_words: int | None = None, known_share: int = KNOWN_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows that aren't held out.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    model, words = fit(read.where(~F.col("held_out")).select("text"), classes, core_words, known_share)
    shared = spark.sparkContext.broadcast(model)
    row = F.struct("doc_id", "held_out", F.monotonically_increasing_id().alias("nth")).alias("row")
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"row struct<doc_id:{kind},held_out:boolean,nth:bigint>, {PARTS}"
    parts = materialise(read.select(row, "text").mapInArrow(lambda batches: score_parts(batches, shared.value), fields), "scores")
    # The transition table has (classes + 1) squared rows.
    steps = spark.createDataFrame(
        pa.table({"x": np.repeat(np.arange(classes + 1), classes + 1), "y": np.tile(np.arange(classes + 1), classes + 1), "step": model.step.reshape(-1)})
    )
    into, out, twice = (F.broadcast(steps.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("step").alias(f"step{k}"))) for k in (1, 2, 3))
    sizes = F.array(*(F.lit(float(x)) for x in model.size))
    seen = lambda k: words.select(F.col("h").alias(f"at{k}"), F.col("n").alias(f"c{k}"), F.col("class").alias(f"class{k}"))
    class_of = lambda k: F.coalesce(F.col(f"class{k}"), F.lit(classes))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    one = parts.where("h IS NOT NULL AND h2 IS NULL").select(F.col("row.nth").alias("of"), "h", "before", "then", "n").join(seen(1), F.col("h") == F.col("at1"), "left")
    one = one.join(into, (F.col("before") == F.col("x1")) & (class_of(1) == F.col("y1")), "left").join(out, (class_of(1) == F.col("x2")) & (F.col("then") == F.col("y2")), "left")
    c = F.coalesce(F.col("c1"), F.lit(0))
    emit = F.when(c > 0, F.log10(c + ADD) - F.get(sizes, F.col("class1"))).otherwise(0.0)
    one = one.select("of", "n", F.log10(c + ADD).alias("base"), (c > 0).alias("is_known"), (emit + zero("step1") + zero("step2")).alias("score"))
    two = parts.where("h2 IS NOT NULL").select(F.col("row.nth").alias("of"), "h", "h2", "n").join(seen(1), F.col("h") == F.col("at1"), "left").join(seen(2), F.col("h2") == F.col("at2"), "left")
    two = two.join(twice, (class_of(1) == F.col("x3")) & (class_of(2) == F.col("y3"))).select("of", "n", F.lit(0.0), F.lit(False), F.col("step3"))
    n = F.col("n")
    more = one.union(two).groupBy("of").agg(F.sum(n * F.col("base")).alias("more_base"), F.sum(F.when(F.col("is_known"), n).otherwise(0)).alias("more_known"), F.sum(n * F.col("score")).alias("more_score"))
    whole = parts.where("h IS NULL").join(more, F.col("row.nth") == F.col("of"), "left")
    norm = float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    return whole.select(
        "row.doc_id", "row.held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )
