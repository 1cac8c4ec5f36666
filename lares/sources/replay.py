"""Rebuilding the tables from what was landed, without asking any source again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lares.operators.quality import outside_fence
from lares.operators.versions import one_per_instant, versions
from lares.params import DEFAULT, Params
from lares.session import cut
from lares.sources.landing import replay_status

#: What an extractor gives for every blob it is given: the captures in it, an empty list if it can't be read.
CAPTURE = "struct<unit_key: string, captured: timestamp_ntz, price_uf: double, price_clp: double, zone: string, event_id: bigint>"
Extractor = Callable[[DataFrame], DataFrame]


def json_captures(blobs: DataFrame) -> DataFrame:
    """Blobs that are one JSON object or an array of them."""
    text = F.trim("content")
    whole = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return blobs.withColumn("captures", F.from_json(whole, f"array<{CAPTURE}>"))


def line_captures(blobs: DataFrame) -> DataFrame:
    """Blobs of one capture a line, fields parted by bars, in the order of ``CAPTURE``; a blob with a broken line is not read."""
    fields = lambda line: F.split(line, r"\|")
    empty = lambda x: F.when(x != "", x)

    def capture(line):
        f = fields(line)
        at = lambda i: F.try_element_at(f, F.lit(i + 1))
        return F.struct(at(0).alias("unit_key"), at(1).try_cast("timestamp_ntz").alias("captured"), empty(at(2)).try_cast("double").alias("price_uf"), empty(at(3)).try_cast("double").alias("price_clp"),
                        empty(at(4)).alias("zone"), at(5).try_cast("bigint").alias("event_id"))

    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    return blobs.withColumn("captures", F.when(F.forall(lines, lambda x: F.size(fields(x)) == 6), F.transform(lines, capture)))


def replayed(blobs: DataFrame, metadata: DataFrame, registry: dict[str, Extractor]) -> tuple[DataFrame, DataFrame]:
    """(captures, errors) of all landed blobs: blob, source_id, content.

    Every blob goes to the extractor that is registered for its source, all of them in one job.
    One that has no metadata, no extractor, or nothing that can be read in it is a row of the
    errors with its reason; none is dropped.
    """
    spark = blobs.sparkSession
    parsers = spark.createDataFrame([(s,) for s in sorted(registry)], "source_id string")
    status = replay_status(blobs, metadata, parsers)
    ready = status.where("status = 'replayable'")
    parts = [extract(ready.where(F.col("source_id") == s)).select("blob", "source_id", "captures") for s, extract in sorted(registry.items())]
    read = cut(reduce(DataFrame.unionByName, parts))
    whole = F.coalesce((F.size("captures") > 0) & F.forall("captures", lambda c: c["unit_key"].isNotNull() & c["captured"].isNotNull() & c["event_id"].isNotNull()), F.lit(False))
    rows = read.where(whole).select("blob", "source_id", F.inline("captures"))
    errors = read.where(~whole).select("blob", "source_id", F.lit("unreadable").alias("reason"))
    return rows, errors.unionByName(status.where("status <> 'replayable'").select("blob", "source_id", F.col("status").alias("reason")))


def rebuilt(captures: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Versions from replayed captures, open ones flagged again against the prices of their zone."""
    v = cut(versions(one_per_instant(captures.drop("blob", "source_id")), ["zone"]))
    open_ = v.where("valid_to IS NULL AND price_uf IS NOT NULL AND zone IS NOT NULL").select(F.col("unit_key"), "zone", "price_uf")
    odd = outside_fence(open_, "zone", "price_uf", p).select("unit_key", F.lit(True).alias("_odd"))
    flag = F.col("valid_to").isNull() & F.coalesce("_odd", F.lit(False))
    return v.join(odd, "unit_key", "left").withColumn("suspicious", flag).drop("_odd")
