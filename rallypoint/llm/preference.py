"""Preference formatting: one prompt, two completions with loss masks.

Chosen and rejected conversations are compared turn by turn; their longest
common turn prefix is rendered once as the prompt, and what follows in each is
rendered as its completion. A completion's mask lists the character spans
(start, end) of assistant text and its end mark, which alone carry loss.

Control marks in a role or text are escaped: between `<` and `|`, with any
backslashes between, goes one backslash more. Taking one out of each such place
gives the text back, and no text can open or end a turn. Masks count the
rendered characters.

Defined results for unusual input: a conversation is one row, however long;
turns are ordered by turn number (nulls
first), then role and text, so ties and repeated rows are turns in a row; a null
role or text is rendered as empty and equals only null; a pair that has one side
only is left out, as is a null pair id; equal conversations give two empty
completions; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rallypoint.llm.common import materialise

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def conversations(turns: DataFrame, pair: str) -> DataFrame:
    """pair, turns: the sorted (turn, role, text) structs of each conversation."""
    rows = turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(escaped(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def loss_spans(turns: Column) -> Column:
    """start:end of each assistant body in the rendered turns, comma-joined; end exclusive."""
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("own"), F.length(_head(t)).alias("head"), F.length(_body(t)).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["head"]
        span = F.array(F.concat_ws(":", begin, begin + t["body"]))
        return F.struct((begin + t["body"]).alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(sizes, start, add, lambda acc: acc["spans"]), ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many leading turns agree in role and text."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str) -> DataFrame:
    """One row per pair of chosen and rejected turns (columns pair, turn, role, text)."""
    both = conversations(chosen, pair).withColumnRenamed("turns", "c").join(conversations(rejected, pair).withColumnRenamed("turns", "r"), "pair_id")
    both = both.withColumn("n_common", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.size(side))
    cut = both.select("pair_id", "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id",
        "n_common",
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        loss_spans(F.col("c")).alias("chosen_mask"),
        loss_spans(F.col("r")).alias("rejected_mask"),
    )


def last_replies(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, last: the last assistant turn of each conversation that has one, wherever it stands."""
    own = turns.where(F.col(conv).isNotNull() & (F.col("role") == "assistant"))
    return own.groupBy(conv).agg(F.max(F.struct("turn", "role", "text")).alias("last"))


def without_reply(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns: the conversations that have no assistant turn and so no pair."""
    counts = turns.where(F.col(conv).isNotNull()).groupBy(conv).agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n"))
    return counts.where("n = 0").drop("n")


def with_next(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds next: the value of the next key in order, the first one's for the last key (keys are distinct).

    Ranges of keys are ordered task by task; the value behind a range's end is
    that of the next range's first key, so only one row a range meets in one task.
    """
    parts = materialise(rows.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ranges")
    firsts = parts.groupBy("part").agg(F.min_by(F.struct(value), key).alias("first"))
    order = W.partitionBy(F.lit(0)).orderBy("part")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("behind"))
    inside = F.lead(F.struct(value)).over(W.partitionBy("part").orderBy(key))
    found = parts.withColumn("inside", inside).join(F.broadcast(ends), "part")
    return found.withColumn("next", F.coalesce("inside", "behind")[value]).drop("part", "inside", "behind")


def replies_from_next(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """For each conversation that has an assistant turn, a rejected twin.

    The twin has the same turns, but the text of its last assistant turn is that
    of the next such conversation in the order of conv, the first one's for the
    last. `without_reply` lists the conversations that get no twin.
    """
    own = with_next(last_replies(turns, conv), conv, "last")
    twins = own.select(F.col(conv).alias("of"), F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"), F.col("next.text").alias("reply"))
    is_last = F.col("turn").eqNullSafe(F.col("last_turn")) & F.col("text").eqNullSafe(F.col("last_text")) & (F.col("role") == "assistant")
    return turns.join(twins, F.col(conv) == F.col("of")).select(F.col(conv), "turn", "role", F.when(is_last, F.col("reply")).otherwise(F.col("text")).alias("text"))
