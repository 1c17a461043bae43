"""Stateful streams: players' histories walked page by page, and the seal behind a newer patch.

State lies in Spark's state store, so a restart from the checkpoint goes on where
the last finished batch ended. Sessions need the RocksDB provider (STATE_STORE).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

CUT, FULL, EXAMINED = "history_old_patch_cutoff", "history_max_reached", "history_examined"


class HistoryWalk(StatefulProcessor):
    """Walks each player's rows from the newest back: offset, run of older rows, status.

    A batch holds the next, older page of a player's history, in any order of rows. A
    walk ends behind the stop_after-th older row in a row, or at `most` rows; what
    comes later for that player is left alone.
    """

    def __init__(self, stop_after: int, most: int) -> None:
        self.stop_after, self.most = stop_after, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.walk = handle.getValueState("walk", "offset int, run int, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        offset, run, status = self.walk.get() if self.walk.exists() else (0, 0, EXAMINED)
        page = pd.concat(list(rows)).sort_values(["at", "tie"], ascending=False)
        for old in page["old"].tolist():
            if status != EXAMINED:
                break
            offset, run = offset + 1, run + 1 if old else 0
            status = CUT if run >= self.stop_after else FULL if offset >= self.most else EXAMINED
        self.walk.update((offset, run, status))
        yield pd.DataFrame({"player": [key[0]], "offset": [offset], "consecutive_older": [run], "status": [status]})

    def close(self) -> None:
        pass


def walked(source: DataFrame, player: str, at: str, tie: str, older: Column, stop_after: int, most: int) -> DataFrame:
    """A stream of player, offset, consecutive_older, status: a row for each player and batch; a player's last one counts."""
    rows = source.select(F.col(player).alias("player"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.coalesce(older, F.lit(False)).alias("old"))
    kind = rows.schema["player"].dataType.simpleString()
    return rows.groupBy("player").transformWithStateInPandas(HistoryWalk(stop_after, most), f"player {kind}, offset int, consecutive_older int, status string", "Update", "None")


class PatchSeal(StatefulProcessor):
    """Counts a platform's matches by side of the target patch, and seals it some time after the first newer one.

    side is older, target or newer. The first newer match sets a timer; matches
    up to its time are counted still, those behind it are refused, in whatever batch they come. A row
    is given when a platform is sealed.
    """

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "accepted bigint, older bigint, newer bigint, refused bigint, first_newer bigint, patch string, sealed boolean")

    def _now(self) -> list:
        return list(self.counts.get()) if self.counts.exists() else [0, 0, 0, 0, None, None, False]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self._now()
        for r in pd.concat(list(rows)).sort_values(["at", "tie"]).itertuples():
            at = int(r.at.value // 1_000_000)
            if now[6] or (now[4] is not None and at > now[4] + self.grace_ms):
                now[3] += 1
                continue
            now[{"target": 0, "older": 1, "newer": 2}[r.side]] += 1
            if r.side == "newer" and now[4] is None:
                now[4], now[5] = at, r.patch
                self.handle.registerTimer(now[4] + self.grace_ms)
        self.counts.update(tuple(now))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = self._now()
        now[6] = True
        self.counts.update(tuple(now))
        yield pd.DataFrame({"platform": [key[0]], "patch": [now[5]], "accepted": [now[0]], "older": [now[1]], "newer": [now[2]], "first_newer": [pd.Timestamp(now[4], unit="ms")]})

    def close(self) -> None:
        pass


def sealed(source: DataFrame, platform: str, at: str, tie: str, patch: str, side: Column, grace_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of platform, patch (the first newer one), accepted, older, newer, first_newer: a row when a platform is sealed."""
    rows = source.withWatermark(at, late).select(F.col(platform).alias("platform"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(patch).alias("patch"), side.alias("side"))
    return rows.groupBy("platform").transformWithStateInPandas(PatchSeal(grace_ms), "platform string, patch string, accepted bigint, older bigint, newer bigint, first_newer timestamp", "Append", "EventTime")


def run_available(stream: DataFrame, folder: str, sink: str, mode: str, add: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Processes what the source holds now, batch by batch, into folder/sink; returns all rows so far with their batch.

    A batch that runs again after a failure replaces its own rows.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = add(batch) if add else batch
        rows.write.mode("overwrite").parquet(f"{folder}/{sink}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/{sink}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/{sink}")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last batch that has one."""
    found = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("x"))
    return found.select(key, "x.*")
