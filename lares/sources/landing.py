"""Raw-document landing, inventories, manifests and replay checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.sources.pages import BASE_URL


def landed(docs: DataFrame) -> DataFrame:
    """Documents with content hash, size, date partition and a safe file name.

    ``docs``: source_id, source_url, fetched_at, parser_version, robots_snapshot_sha, content.
    Secrets in the URL never reach the name.
    """
    from lares.functions.exprs import mask_secret
    name = F.regexp_replace(F.regexp_replace(mask_secret(F.col("source_url")), r"^[a-z]+://[^/]*/?", ""), r"[^A-Za-z0-9._-]", "_")
    return docs.withColumns({
        "source_url": mask_secret(F.col("source_url")), "sha": F.sha2("content", 256), "bytes": F.octet_length("content"),
        "fetch_date": F.to_date("fetched_at"), "name": F.when(name == "", "index").otherwise(name)})


def write_bronze(docs: DataFrame, path: str) -> None:
    """One partition per source and day; landing the same day again replaces that day."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "fetch_date").parquet(path)


def replay_status(blobs: DataFrame, metadata: DataFrame, parsers: DataFrame) -> DataFrame:
    """Each landed blob as ``replayable``, ``no_metadata`` or ``no_parser``; none is dropped."""
    j = blobs.join(metadata.select("blob", F.lit(True).alias("_m")), "blob", "left").join(
        parsers.select("source_id", F.lit(True).alias("_p")), "source_id", "left")
    return j.withColumn("status", F.when(F.col("_m").isNull(), "no_metadata").when(F.col("_p").isNull(), "no_parser").otherwise("replayable")).drop("_m", "_p")


def manifest_actions(incoming: DataFrame, landed_files: DataFrame) -> DataFrame:
    """name, action: copied, already_there, conflict (same name, other hash: never overwritten), landed_only."""
    a, b = incoming.alias("a"), landed_files.alias("b")
    action = (F.when(F.col("b.name").isNull(), "copied").when(F.col("a.name").isNull(), "landed_only")
              .when(F.col("a.sha") == F.col("b.sha"), "already_there").otherwise("conflict"))
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"), action.alias("action"))


def inventory(docs: DataFrame) -> DataFrame:
    """Documents and distinct searches per source and day."""
    return docs.groupBy("source_id", "day").agg(F.count("*").alias("documents"), F.count_distinct("search").alias("searches"))


def text_grep(docs: DataFrame, pattern: str, context: int = 30) -> DataFrame:
    """Documents that match, with the number of hits and the first hit in its context; whole texts are searched."""
    t = F.col("text")
    first = F.regexp_extract(t, pattern, 0)
    at = F.position(first, t)
    start = F.greatest(at - context, F.lit(1))
    return docs.where(t.rlike(pattern)).select(
        "doc_id", F.regexp_count(t, F.lit(pattern)).alias("hits"),
        F.substr(t, start, at - start + F.length(first) + context).alias("snippet"))


# ----------------------------------------------------------------- dated snapshot files


def snapshot_date(name: Column) -> Column:
    """Capture day from the file name, never from the clock: ``..._YYYYMMDD.html``."""
    raw = F.regexp_extract(name, r"_(\d{4})(\d{2})(\d{2})\.html$", 0)
    ymd = F.substring(raw, 2, 8)
    return F.concat_ws("-", F.substring(ymd, 1, 4), F.substring(ymd, 5, 2), F.substring(ymd, 7, 2)).try_cast("date")


def listing_page_parts(name: Column) -> tuple[Column, Column, Column]:
    """(operation, place, page number) from ``venta_san-miguel_p01_20260504.html``."""
    pat = r"^(venta|arriendo)_([a-z-]+)_p(\d+)_"
    part = lambda i: F.nullif(F.regexp_extract(name, pat, i), F.lit(""))
    return part(1), part(2), part(3).try_cast("int")


def detail_page_url(name: Column) -> Column:
    lid = F.regexp_extract(name, r"^(MLC-\d+)_", 1)
    return F.when(lid != "", F.concat(F.lit(BASE_URL + "/"), lid))


def scan_snapshots(spark, path: str) -> DataFrame:
    """Saved pages of a folder as rows: name, captured day and content, read by Spark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("name"), snapshot_date(name).alias("day"), F.col("content").cast("string").alias("html"), F.col("length").alias("bytes"))
