"""Stage tables: published once, checked, and read back as the next stage's input."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallypoint.sources.writers import Writer, hold, read_small


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and the session local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a stage table and reads it back, so that later readers share the work."""
    path = f"{work_dir(df.sparkSession, label)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def still_there(df: DataFrame) -> bool:
    """Whether a stage table's files haven't been cleared away since."""
    return all(exists(df.sparkSession, folder) for folder in {f.rpartition("/")[0] for f in df.inputFiles()})


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows as a multiset: equal for equal rows in any order."""
    h = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(df.columns)))
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}:{mixed or 0}"


def publish(df: DataFrame, path: str, checks: DataFrame | None = None) -> bool:
    """Publishes an immutable stage at path; True if written, False if the same rows are there.

    Other rows at the path are an error, as is a check table (check, failures)
    with failures.
    """
    spark = df.sparkSession
    require(checks)
    if exists(spark, path):
        if fingerprint(spark.read.parquet(path)) != fingerprint(df):
            raise ValueError(f"{path} holds other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def require(checks: DataFrame | None) -> None:
    """Raises if the check table (check, failures) has failures."""
    if checks is not None and (failed := checks.where("failures > 0").limit(20).collect()):
        raise ValueError("checks failed: " + ", ".join(f"{r['check']} ({r['failures']})" for r in failed))


_POINTER = "no bigint, name string, path string"


def publish_version(df: DataFrame, base: str, name: str, checks: DataFrame | None = None, writer: Writer | None = None) -> bool:
    """Publishes df as the newest version of a replaceable stage; True if written, False if it holds the newest version's rows.

    One writer holds the folder at a time (Busy otherwise). Failed checks, and a
    written copy that differs from df, leave the newest version as it was: versions
    are folders of their own, and a commit file that no other writer can put too
    makes one the newest. Raises Fenced if the writer was taken over meanwhile.
    """
    if writer is None:
        with hold(df.sparkSession, base) as own:
            return publish_version(df, base, name, checks, own)
    spark = df.sparkSession
    require(checks)
    newest = max(versions(spark, base).collect(), key=lambda r: r.no, default=None)
    wanted = fingerprint(df)
    if newest and fingerprint(spark.read.parquet(newest.path)) == wanted:
        return False
    path = f"{base}/versions/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if fingerprint(spark.read.parquet(path)) != wanted:
        raise ValueError("the written rows are not those that were to be published")
    _commit(writer, newest.no + 1 if newest else 1, name, path)
    return True


def _commit(writer: Writer, no: int, name: str, path: str) -> None:
    writer.commit(f"{writer.base}/commits/{no:020d}", {"no": no, "name": name, "path": path})


def versions(spark: SparkSession, base: str) -> DataFrame:
    """no, name, path of all published versions."""
    found = [(x["no"], x["name"], x["path"]) for x in read_small(spark, f"{base}/commits").values()]
    return spark.createDataFrame(found, _POINTER)


def roll_back(spark: SparkSession, base: str) -> None:
    """Makes the version before the newest one the newest again."""
    with hold(spark, base) as writer:
        known = sorted(versions(spark, base).collect(), key=lambda r: r.no)
        if len(known) < 2:
            raise ValueError("no version to go back to")
        _commit(writer, known[-1].no + 1, known[-2].name, known[-2].path)


def snapshots(spark: SparkSession, base: str, which: str = "latest") -> DataFrame:
    """The rows of the latest version, of the newest one with this name, or of all (`all`, with columns version and name)."""
    known = sorted(versions(spark, base).collect(), key=lambda r: r.no)
    if which == "all":
        parts = [spark.read.parquet(r.path).withColumns({"version": F.lit(r.no), "version_name": F.lit(r.name)}) for r in known]
        return reduce(DataFrame.unionByName, parts)
    found = [r for r in known if which in ("latest", r.name)]
    if not found:
        raise ValueError(f"no version {which}")
    return spark.read.parquet(found[-1].path)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one JSON object of a file as one row; anything else is an error."""
    found = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if found.count() != 1:
        raise ValueError(f"{path} is not one JSON object")
    return found


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def require_lineage(inputs: dict[str, DataFrame], recorded: dict[str, str]) -> None:
    """Raises if an input's fingerprint is not the one recorded for it."""
    for name, df in inputs.items():
        if fingerprint(df) != recorded.get(name):
            raise ValueError(f"input {name} is not the one recorded")
