"""Typed JSON lines, partitioned match files, blobs and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallypoint.functions.formulas import safe_segment

#: Raw match payloads; unknown fields stay in the text that callers keep beside them.
MATCH = """metadata struct<matchId:string>, info struct<gameCreation:bigint,gameDuration:int,gameVersion:string,queueId:int,gameMode:string,platformId:string,
    participants:array<struct<participantId:int,puuid:string,teamId:int,championId:int,championName:string,teamPosition:string,individualPosition:string,win:boolean,
        kills:int,deaths:int,assists:int,goldEarned:int,totalMinionsKilled:int,neutralMinionsKilled:int,
        perks:struct<styles:array<struct<description:string,style:int,selections:array<struct<perk:int>>>>>>>,
    teams:array<struct<teamId:int,win:boolean,bans:array<struct<championId:int,pickTurn:int>>>>>"""


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed rows of JSON lines; a row that doesn't fit the schema, or repeats a key, fails the read."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.parse_json("value")
    typed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(F.when(parsed.isNotNull(), typed).alias("r")).select("r.*")


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Match files under region=/patch=/queue=; filters on these prune folders."""
    return spark.read.schema(schema).option("basePath", path).json(path)


def write_partitioned(rows: DataFrame, path: str, tasks_per_folder: int = 16, most_rows: int = 1_000_000) -> None:
    """Rows under region/patch/queue folders; a null patch goes to `unresolved`.

    A folder's rows are dealt to several tasks by their match, and no file holds
    more than most_rows.
    """
    patch = F.coalesce("patch", F.lit("unresolved"))
    out = rows.withColumns({"region": safe_segment(F.col("region")), "patch": safe_segment(patch)})
    deal = F.pmod(F.xxhash64("match_id"), F.lit(tasks_per_folder))
    out.repartition("region", "patch", "queue", deal).write.option("maxRecordsPerFile", most_rows).partitionBy("region", "patch", "queue").parquet(path)


def of_match(rows: DataFrame, match_id: str, region: str, patch: str, queue: int) -> DataFrame:
    """One match, from the folder that must hold it."""
    return rows.where((F.col("region") == region) & (F.col("patch") == patch) & (F.col("queue") == queue) & (F.col("match_id") == match_id))


def sorted_bans(bans: Column) -> Column:
    """Bans by pick turn (missing last) and champion (missing first); -1 stays an explicit no-ban."""
    key = lambda b: F.struct(F.coalesce(b["pickTurn"], F.lit(10_000)).alias("k"), F.coalesce(b["championId"], F.lit(-1)).alias("c"), b.alias("ban"))
    return F.transform(F.array_sort(F.transform(bans, key)), lambda x: x["ban"])


def normalize(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match rows of payloads that have the expected shape, and (match_id, reason) of the others."""
    info, people = F.col("info"), F.col("info.participants")
    reason = (
        F.when(F.col("metadata.matchId").isNull(), "missing_match_id").when(~F.coalesce(info["queueId"] == 420, F.lit(False)), "unsupported_queue")
        .when(~F.coalesce(F.size(people) == 10, F.lit(False)), "unexpected_participant_count").when(~F.coalesce(F.size(info["teams"]) == 2, F.lit(False)), "unexpected_team_count")
    )
    marked = payloads.withColumn("reason", reason)
    created = F.timestamp_millis(info["gameCreation"])
    kept = marked.where("reason IS NULL").select(F.col("metadata.matchId").alias("match_id"), created.alias("game_creation"), info["gameDuration"].alias("duration_seconds"), info["queueId"].alias("queue_id"), info["platformId"].alias("platform"), info["gameVersion"].alias("version"), people.alias("participants"), info["teams"].alias("teams"))
    return kept, marked.where("reason IS NOT NULL").select(F.col("metadata.matchId").alias("match_id"), "reason")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size, digest of every file below path, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def tree_digest(files: DataFrame) -> str:
    """One digest over the files' paths, sizes and digests, folded by path ranges."""
    line = F.concat_ws("\0", "path", F.col("size").cast("string"), "digest")
    parts = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "d"))), "\n"), 256)).first()[0]


def blob_path(digest: Column) -> Column:
    """Where content of this digest lies: a folder of its first two digits."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".json"))


def verified(files: DataFrame) -> DataFrame:
    """Files of a content-addressed store; one whose content doesn't match its name raises an error."""
    name = F.regexp_extract("path", r"([0-9a-f]{64})\.json$", 1)
    return files.withColumn("digest", F.when(name == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("content differs from its name: "), F.col("path")))))


def storage_projection(files: DataFrame, component: Column, matches: int, target: int = 10_000, reserve: float = 1.10) -> DataFrame:
    """component, n_files, size, projected: bytes by component, carried on linearly to the target."""
    sums = files.groupBy(component.alias("component")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size"))
    return sums.withColumn("projected", F.ceil(F.col("size") * (target / matches * reserve)))


def keystones(trees: DataFrame) -> DataFrame:
    """style, keystone, name: the first slot's entries of every tree; repeated ids raise an error."""
    flat = trees.select(F.col("id").alias("style"), F.explode(F.get("slots", F.lit(0))["runes"]).alias("r")).select("style", F.col("r.id").alias("keystone"), F.col("r.name").alias("name"))
    counted = flat.groupBy("style", "keystone").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    return counted.select("style", "keystone", F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.lit("a keystone repeats"))).alias("name"))


def map_keystone(rows: DataFrame, perks: str, known: DataFrame) -> DataFrame:
    """Adds keystone_id and keystone_status from the one primary style's selections."""
    styles = F.coalesce(F.col(f"{perks}.styles"), F.array().cast(rows.select(f"{perks}.styles").schema[0].dataType))
    primary = F.filter(styles, lambda s: F.lower(F.trim(s["description"])) == "primarystyle")
    tree = F.get(primary, F.lit(0))
    chosen = F.filter(F.transform(tree["selections"], lambda s: s["perk"]), lambda p: p.isNotNull())
    trees = known.groupBy(F.col("style").alias("of_style")).agg(F.collect_set("keystone").alias("of_keystones"))
    out = rows.withColumns({"primary_n": F.size(primary), "primary_style": tree["style"], "primary_perks": F.coalesce(chosen, F.array().cast("array<int>"))})
    out = out.join(trees, F.col("primary_style") == F.col("of_style"), "left")
    met = F.array_intersect("primary_perks", "of_keystones")
    status = (
        F.when(F.col(perks).isNull(), "perks_missing").when(F.size(styles) == 0, "styles_missing").when(F.col("primary_n") == 0, "primary_style_missing")
        .when(F.col("primary_n") > 1, "primary_style_ambiguous").when(F.col("primary_style").isNull(), "primary_style_id_missing").when(F.col("of_style").isNull(), "primary_style_unknown")
        .when(F.size("primary_perks") == 0, "selections_missing").when(F.size(met) == 0, "keystone_unmatched").when(F.size(met) > 1, "keystone_ambiguous").otherwise("mapped")
    )
    return out.withColumns({"keystone_status": status, "keystone_id": F.when(status == "mapped", F.get(met, F.lit(0)))}).select(*rows.columns, "keystone_id", "keystone_status")


def newest_version(versions: DataFrame, prefix: str) -> str | None:
    """The highest version, by numbers, of those that begin with the prefix."""
    parts = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
    found = versions.where(F.col("version").rlike(r"^\d+(\.\d+)*$") & (F.col("version").startswith(prefix + ".") | (F.col("version") == prefix)))
    return found.agg(F.max_by("version", parts)).first()[0]
