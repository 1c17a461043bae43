"""Benchmark decontamination over template windows, in DataFrame functions only.

A text becomes a sequence of tokens (runs of letters or digits; a number keeps
its inner points and commas out of the way, so 1,250.5 is one token). Tokens
with a digit turn into `#` and a unit behind a number into `~`. Two readings
follow: one turns every capitalised word into `@`, a name's place; the other
turns none, so that copies in other case meet. Five-token template windows of
documents and benchmark items meet, in either reading, in an equality join; a
document leaks an item if it holds 0.8 or more of the item's windows and the
values behind the placeholders map consistently: equal item values must stand
against equal document values, either within one alignment or over all of them.
So a question with new numbers or names is caught, wherever these stand and
however its lines are broken, and a chance fit of placeholders is not.

Items with the same windows in the first reading, whose values are equal in the
same places, are one class, and a document meets each class once, by the class's
least item. Another item of the class is met for itself only by documents that
hold a window of its second reading, with its own names, and leaks only where the
class doesn't. So leaks and class members grow with documents plus items, however
many items share a template.

Exactness: a document with 0.8 of an item's windows holds at least one of any
`n - ceil(0.8 n) + 1` of them, so the first pass over the texts probes only that
many of each item's windows, the rarest among items. Documents that hit are
read again and verified in full, against the items whose windows they hit alone.
Nothing is capped.

Defined results for unusual input: a window with fewer than two words that are
no placeholder is compared by its own tokens; a text of one to four tokens is
one window, which only an item of the same tokens meets; texts without tokens
(null, empty, blank) leak nothing; a very long text is read whole; a null doc_id
is an id like others; repeated rows give one row per (doc_id, text, class); items
that repeat are one class; an item without tokens has none; empty tables give empty results; other
columns, whatever their names, pass through drop_leaks untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.llm.common import free_name, materialise

WINDOW = 5
SIMILARITY_PERCENT = 80
LEAST_LITERALS = 2
# Units of measurement.
UNITS = (
    "mm cm m km in ft yd mi miles meters metres kilometers g kg mg lb lbs oz grams kilograms pounds tons l ml liters litres gallons s sec "
    "seconds min minutes h hr hours days weeks months years mph kmh c f k degrees percent dollars cents euros usd eur w kw v hz khz mhz ghz"
).split()
SLOTS = ("#", "@", "~")


def clean(text: Column) -> Column:
    """Lower-case tokens, single spaces between; words that began with a capital carry `@` in front."""
    free = F.when(text.contains("@"), F.translate(text, "@", " ")).otherwise(text)
    whole = F.regexp_replace(free, "([0-9])[.,](?=[0-9])", "$1")
    marked = F.regexp_replace(whole, r"(^|[^\p{L}\p{N}])(\p{Lu})", "$1@$2")
    return F.lower(F.trim(F.regexp_replace(marked, r"[^\p{L}\p{N}@]+", " ")))


def template(cleaned: Column) -> Column:
    """The cleaned text with `#` and `~`, token for token alike; names are still to be read."""
    numbers = F.regexp_replace(F.concat(cleaned, F.lit(" ")), "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "#")
    return F.rtrim(F.regexp_replace(numbers, f"# @?({'|'.join(UNITS)}) ", "# ~ "))


def named(templated: Column) -> Column:
    return F.split(F.regexp_replace(templated, "@[^ ]+", "@"), " ")


def unnamed(templated: Column) -> Column:
    return F.split(F.replace(templated, F.lit("@"), F.lit("")), " ")


def _short(tokens: Column) -> Column:
    return F.concat(F.lit("short "), F.array_join(tokens, " "))


def _hashes(tokens: str) -> Column:
    t = F.col(tokens)
    starts = F.sequence(F.lit(0), F.size(t) - WINDOW)
    each = F.transform(starts, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(WINDOW))))
    return F.when(F.size(t) < WINDOW, F.array(F.xxhash64(_short(t)))).otherwise(each)


def probe_hashes(texts: DataFrame, text: Column, *ids: str) -> DataFrame:
    """ids, hash: the hashes of all template windows of every text, in both readings.

    Templates and tokens are columns of their own, so that no window computes them again.
    """
    templated = texts.select(*ids, template(clean(F.coalesce(text, F.lit("")))).alias("s"))
    tokens = templated.select(*ids, named(F.col("s")).alias("a"), unnamed(F.col("s")).alias("b"))
    return tokens.select(*ids, F.explode(F.concat(_hashes("a"), _hashes("b"))).alias("hash"))


def windows(texts: DataFrame, text: Column, *ids: str) -> DataFrame:
    """ids, at, key, hash, own, slots, n_windows, r: every window of every text, once a reading (r 0 and, where it differs, 1).

    own holds the window's tokens, slots its placeholders' places; key is what
    must be equal for windows to meet.
    """
    cleaned = free_name(texts, "cleaned")
    split = texts.withColumn(cleaned, clean(F.coalesce(text, F.lit("")))).where(F.col(cleaned) != "")
    s = template(F.col(cleaned))
    split = split.select(*ids, unnamed(F.col(cleaned)).alias("o"), named(s).alias("a"), unnamed(s).alias("b"))
    n = F.greatest(F.size("o") - WINDOW, F.lit(0))
    length = F.least(F.size("o"), F.lit(WINDOW))
    part = lambda c, i: F.slice(c, i + 1, length)
    cut = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("at"), part("o", i).alias("own"), F.array(F.struct(part("a", i).alias("like"), F.lit(0).alias("r")), F.struct(part("b", i).alias("like"), F.lit(1).alias("r"))).alias("likes")))
    each = split.select(*ids, (n + 1).alias("n_windows"), F.explode(cut).alias("w")).select(*ids, "n_windows", "w.at", "w.own", F.explode(F.when(F.get("w.likes", F.lit(0))["like"] == F.get("w.likes", F.lit(1))["like"], F.slice("w.likes", 1, 1)).otherwise(F.col("w.likes"))).alias("l"))
    return _keyed(each.select(*ids, "n_windows", "at", "own", "l.like", "l.r"), *ids)


def _keyed(cut: DataFrame, *ids: str) -> DataFrame:
    is_slot = lambda x: x.isin(*SLOTS)
    literals = F.size(F.filter("like", lambda x: ~is_slot(x)))
    size = F.size("like")
    typed = (size >= WINDOW) & (literals >= LEAST_LITERALS)
    tokens = F.when(typed, F.col("like")).otherwise(F.col("own"))
    return cut.select(
        *ids,
        "at",
        F.concat(F.when(size < WINDOW, F.lit("short ")).otherwise(F.when(typed, F.lit("t ")).otherwise(F.lit("o "))), F.array_join(tokens, " ")).alias("key"),
        F.when(size < WINDOW, F.xxhash64(_short(F.col("like")))).otherwise(F.xxhash64(*(F.get("like", F.lit(k)) for k in range(WINDOW)))).alias("hash"),
        "own",
        F.when(typed, F.filter(F.transform("like", lambda x, i: F.when(is_slot(x), i)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>")).alias("slots"),
        "n_windows",
        "r",
    )


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, row, at, key, hash, own, slots, n_windows, r: the windows of each item; r is 1 if the second reading alone has the key."""
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return windows(rows, F.col("text"), "item_id", "row").withColumn("r", F.min("r").over(W.partitionBy("row", "at", "key")))


def item_classes(filed: DataFrame) -> DataFrame:
    """row, item_id, class_row, class_item of every item with windows; the class's least item_id (nulls last) stands for it.

    A window's signature is its key and, for each placeholder, where the item's
    value came up first; an item's is those of its windows in turn.
    """
    first_reading = filed.where("r = 0")
    spots = first_reading.select("row", "at", "key", F.posexplode("slots").alias("nth", "i"), "own").select("row", "at", "key", "nth", F.get("own", F.col("i")).alias("value")).distinct()
    first = F.min(F.struct("at", "key", "nth")).over(W.partitionBy("row", "value"))
    patterns = spots.withColumn("first", first).groupBy("row", "at", "key").agg(F.to_json(F.array_sort(F.collect_list(F.struct("nth", "first")))).alias("pattern"))
    signed = first_reading.select("row", "item_id", "at", "key").distinct().join(patterns, ["row", "at", "key"], "left").select("row", "item_id", "at", F.sha2(F.concat_ws("|", "key", F.coalesce("pattern", F.lit(""))), 256).alias("digest"))
    items = signed.groupBy("row", "item_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("at", "digest")))), 256).alias("signature"))
    least = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "row")).over(W.partitionBy("signature"))
    return items.select("row", "item_id", least["row"].alias("class_row"), least["item_id"].alias("class_item"))


def _prepared(items: DataFrame, item_text: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    """All items' windows with their class_row and class_item, and all items' classes."""
    filed = materialise(item_windows(items, item_text, item_id), "items")
    classes = materialise(item_classes(filed), "item-classes")
    own = classes.select(F.col("row").alias("of"), "class_row", "class_item")
    return materialise(filed.join(own, F.col("row") == F.col("of")).drop("of"), "class-windows"), classes


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, n_found, class_item_id: the item classes that each document leaks, by their
    least items, and other items of classes that it leaks by those alone."""
    return _leaks(docs, _prepared(items, item_text, item_id)[0], text, doc_id)


def leaks_and_members(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_windows, n_found, class_item_id: the rows of find_leaks, and, with nulls for doc_id, n_windows
    and n_found, a row for each item of a class but its least."""
    filed, classes = _prepared(items, item_text, item_id)
    leaks = _leaks(docs, filed, text, doc_id).drop("text_hash")
    kinds = {f.name: f.dataType for f in leaks.schema}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("doc_id", "n_windows", "n_found")}
    members = classes.where("row <> class_row").select(none["doc_id"], "item_id", none["n_windows"], none["n_found"], F.col("class_item").alias("class_item_id"))
    return leaks.unionByName(members)


def _leaks(docs: DataFrame, filed: DataFrame, text: str, doc_id: str) -> DataFrame:
    need = F.ceil(F.col("n_windows") * SIMILARITY_PERCENT / 100)
    least = filed.where("row = class_row")
    shared = least.groupBy("hash").agg(F.count(F.lit(1)).alias("n_items"))
    place = least.join(shared, "hash").withColumn("at_most", F.max("n_items").over(W.partitionBy("row", "at")))
    rarest = place.withColumn("nth", F.dense_rank().over(W.partitionBy("row").orderBy("at_most", "at"))).where(F.col("nth") <= F.col("n_windows") - need + 1)
    probes = rarest.select(F.col("hash").alias("probe"), F.col("row").alias("probe_row")).union(filed.where("row <> class_row AND r = 1").select("hash", "row")).distinct()
    probes = materialise(probes, "probes")
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    hashes = probe_hashes(read, F.col("text"), "doc_id", "text_hash")
    # The hashes alone, a smaller table, say which windows of all texts stay; only these meet the items.
    alone = materialise(probes.select(F.col("probe").alias("alone")).distinct(), "probe-hashes")
    found = materialise(hashes.join(alone, F.col("hash") == F.col("alone"), "left_semi").distinct(), "found")
    hit = materialise(found.join(probes, F.col("hash") == F.col("probe")).select("doc_id", "text_hash", "probe_row").distinct(), "hit")
    who = materialise(hit.select("doc_id", "text_hash").distinct(), "hit-documents")
    again = read.alias("r").join(who.alias("h"), F.expr("r.text_hash = h.text_hash AND r.doc_id <=> h.doc_id"), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    theirs = windows(again, F.col("text"), "doc_id", "text_hash").select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("doc_hash"), F.col("at").alias("doc_at"), F.col("key").alias("doc_key"), F.col("own").alias("doc_own"))
    asked = hit.join(filed.drop("r"), F.col("probe_row") == F.col("row"))
    met = theirs.join(asked, (F.col("doc_key") == F.col("key")) & (F.col("doc_hash") == F.col("text_hash")) & F.col("doc").eqNullSafe(F.col("doc_id"))).select(
        "doc_id", "text_hash", "item_id", "row", "class_row", "class_item", "n_windows", "at", (F.col("doc_at") - F.col("at")).alias("shift"),
        F.transform("slots", lambda i: F.struct(F.get("own", i).alias("a"), F.get("doc_own", i).alias("b"))).alias("pairs"),
    )
    met = materialise(met, "met")
    pair = ["doc_id", "text_hash", "row"]
    slots = met.select(*pair, "shift", F.explode("pairs").alias("p")).select(*pair, "shift", "p.a", "p.b").distinct()
    passed = []
    for by in (pair, [*pair, "shift"]):
        found = met.groupBy(*by, "item_id", "class_row", "class_item", "n_windows").agg(F.count_distinct("at").alias("n_found")).where(F.col("n_found") >= need)
        torn = slots.groupBy(*by, "a").agg(F.count_distinct("b").alias("n")).where("n > 1").select(*by).distinct()
        same = F.lit(True)
        for c in by:
            same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"t.{c}"))
        passed.append(found.alias("f").join(torn.alias("t"), same, "left_anti").select(*pair, "item_id", "class_row", "class_item", "n_windows", "n_found"))
    leaked = passed[0].union(passed[1]).groupBy(*pair, "item_id", "class_row", "class_item", "n_windows").agg(F.max("n_found").alias("n_found"))
    by_class = F.max((F.col("row") == F.col("class_row")).cast("int")).over(W.partitionBy("doc_id", "text_hash", "class_row"))
    kept = leaked.withColumn("by_class", by_class).where((F.col("row") == F.col("class_row")) | (F.col("by_class") == 0))
    return kept.select("doc_id", "text_hash", "item_id", "n_windows", "n_found", F.col("class_item").alias("class_item_id"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, unchanged, that leak no item."""
    leaks = materialise(find_leaks(docs, items, text, doc_id).select("doc_id", "text_hash").distinct(), "leaks")
    a, b = free_name(docs, "leak_doc"), free_name(docs, "leak_hash")
    gone = leaks.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    return docs.join(gone, (F.xxhash64(docs[text]) == gone[b]) & docs[doc_id].eqNullSafe(gone[a]), "left_anti")
