"""Placement snapshots: writing, reading, checking, choosing and expiring them.

A snapshot is a set of records with one header, one entry per (role, host) and one
footer holding the entry count. Snapshots are kept in one Parquet dataset partitioned by
``saved`` (sixteen hex digits of the save time, so name order is time order), written by
all tasks at once; reading the newest one prunes to its partition. ``read_history_json``
takes the one-file-per-snapshot form, one JSON record per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: the only readable record version
VERSION = 1

_BODY = ("struct<version:int,saved:bigint,savedx:string,savedate:string,roles:int,"
         "host:string,role:int,active:boolean,last_used:bigint,count:bigint>")


def snapshot_name(saved_ms: Column) -> Column:
    return F.lower(F.lpad(F.hex(saved_ms), 16, "0"))


def history_snapshot(cells: DataFrame, saved_ms: int) -> DataFrame:
    """Records of one snapshot of ``cells(role_id, host, live, last_used)``."""
    at = F.lit(saved_ms).cast("long")
    none = lambda t: F.lit(None).cast(t)
    entries = cells.select(
        snapshot_name(at).alias("saved"), F.lit("entry").alias("kind"), F.lit(VERSION).alias("version"),
        at.alias("saved_ms"), none("int").alias("roles"), F.col("host").cast("string").alias("host"),
        F.col("role_id").cast("int").alias("role_id"), (F.col("live") > 0).alias("active"),
        F.col("last_used").cast("long").alias("last_used"), none("long").alias("count"))
    totals = cells.agg(F.count_distinct("role_id").cast("int").alias("_roles"), F.count("*").alias("_count"))
    ends = totals.select(F.inline(F.array(
        F.struct(F.lit("header").alias("kind"), F.col("_roles").alias("roles"), none("long").alias("count")),
        F.struct(F.lit("footer").alias("kind"), none("int").alias("roles"), F.col("_count").alias("count"))))).select(
        snapshot_name(at).alias("saved"), "kind", F.lit(VERSION).alias("version"), at.alias("saved_ms"), "roles",
        none("string").alias("host"), none("int").alias("role_id"), none("boolean").alias("active"),
        none("long").alias("last_used"), "count")
    return entries.unionByName(ends)


def write_history(records: DataFrame, folder: str) -> None:
    """Save snapshots; only their own partitions are written, so saving again replaces them.

    A manifest beside the folder gets one row for each snapshot, so that finding the newest one
    reads no records. It is made from what was written.
    """
    def put(df: DataFrame, to: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("saved").parquet(to)
    spark = records.sparkSession
    put(records, folder)
    mine = read_history(spark, folder).join(F.broadcast(records.select("saved").distinct()), "saved", "left_semi")
    put(check_snapshots(mine).repartition("saved"), manifest_of(folder))


def manifest_of(folder: str) -> str:
    return folder.rstrip("/") + "_manifest"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per saved snapshot, as from ``check_snapshots``."""
    return spark.read.schema("saved string, saved_ms bigint, entries bigint, valid boolean, footer_ok boolean").parquet(
        manifest_of(folder))


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    # partition values would be guessed as numbers for all-digit names
    schema = ("saved string, kind string, version int, saved_ms bigint, roles int, host string, role_id int, "
              "active boolean, last_used bigint, count bigint")
    return spark.read.schema(schema).parquet(folder)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of one-file snapshots, with the file as ``saved`` and a position in it.

    Files must not be split over two reads of this frame for positions to be comparable,
    which one aggregation satisfies.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-fA-F]+)[^/0-9a-fA-F]*(\.json)?$", 1).alias("saved"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("position"), "value")
    return parse_records(lines)


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of text rows ``value``; the other columns stay in front.

    A line is ``{"entry": {"<record type>": {...}}}``; the end of the record type (Header,
    Footer, anything else) tells what it is, and any other line is ``broken``.
    """
    place = [c for c in lines.columns if c != "value"]
    body = F.from_json("value", f"entry map<string,{_BODY}>")
    named = lines.select(*place, F.map_entries(body["entry"])[0].alias("_e"), "value")
    kind = (F.when(F.col("_e").isNull(), "broken").when(F.col("_e.key").endswith("Header"), "header")
            .when(F.col("_e.key").endswith("Footer"), "footer").otherwise("entry"))
    value = F.col("_e.value")
    return named.filter(F.trim("value") != "").select(
        *place, kind.alias("kind"), value["version"].alias("version"),
        value["saved"].alias("saved_ms"), value["roles"].alias("roles"), value["host"].alias("host"),
        value["role"].alias("role_id"), value["active"].alias("active"), value["last_used"].alias("last_used"),
        value["count"].alias("count"))


def check_snapshots(records: DataFrame) -> DataFrame:
    """One row per snapshot: is it readable, and does the footer agree with it.

    With a ``position`` column the header must also come first and the footer last.
    """
    kind = F.col("kind")
    aggs = [
        F.count_if(kind == "header").alias("headers"), F.count_if(kind == "footer").alias("footers"),
        F.count_if(kind == "entry").alias("entries"), F.count_if(kind == "broken").alias("broken"),
        F.max(F.when(kind == "header", F.col("version"))).alias("version"),
        F.max(F.when(kind == "header", F.col("saved_ms"))).alias("saved_ms"),
        F.max(F.when(kind == "footer", F.col("count"))).alias("footer_count")]
    ordered = F.lit(True)
    if "position" in records.columns:
        aggs += [F.min("position").alias("_p0"), F.max("position").alias("_p1"),
                 F.min(F.when(kind == "header", F.col("position"))).alias("_h"),
                 F.max(F.when(kind == "footer", F.col("position"))).alias("_f")]
        ordered = (F.col("_h") == F.col("_p0")) & (F.col("_f") == F.col("_p1"))
    checked = records.groupBy("saved").agg(*aggs)
    valid = ((F.col("headers") == 1) & (F.col("footers") == 1) & (F.col("broken") == 0)
             & F.coalesce(F.col("version") == VERSION, F.lit(False)) & F.coalesce(ordered, F.lit(False)))
    return checked.select("saved", "saved_ms", "entries", valid.alias("valid"),
                          F.coalesce(F.col("footer_count") == F.col("entries"), F.lit(False)).alias("footer_ok"))


def latest_valid_snapshot(records: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Entries of the newest readable snapshot; empty and broken ones are passed over.

    ``checks`` is the manifest or another result of ``check_snapshots``; without it all records are
    checked. With records from ``read_history`` only the partition of that snapshot is scanned.
    """
    checks = check_snapshots(records) if checks is None else checks
    newest = checks.filter("valid").agg(F.max("saved")).scalar()
    return records.filter((F.col("kind") == "entry") & (F.col("saved") == newest))


def expired_snapshots(snapshots: DataFrame, keep: str | None = None) -> DataFrame:
    """Snapshots strictly older than the kept one; an error when that one is missing.

    ``snapshots`` is the manifest or a written result of ``check_snapshots``. Without ``keep`` the
    newest readable one is kept; if there is none, nothing has expired.
    """
    if keep is None:
        return snapshots.filter(F.col("saved") < snapshots.filter("valid").agg(F.max("saved")).scalar()).select("saved")
    if snapshots.filter(F.col("saved") == keep).isEmpty():
        raise ValueError(f"no snapshot {keep}")
    return snapshots.filter(F.col("saved") < keep).select("saved")


def restore_history(entries: DataFrame) -> DataFrame:
    """Entries as cells: one that was active when saved counts as used at that time."""
    return entries.select(
        "role_id", "host", F.when(F.col("active"), F.col("saved_ms")).otherwise(F.col("last_used")).alias("last_used"))
