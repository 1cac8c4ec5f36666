"""Incremental secret scan over content-addressed blobs (operator 10). DataFrame functions only.

Every historical version of a text is a blob named by its SHA-256. The ledger is a table of
(blob, rules, spans): which blobs were scanned with which version of the rules. A scan groups
the versions by blob, removes the (blob, rules) pairs that the ledger holds, scans one text per
remaining blob, adds the new rows to the ledger and joins the findings back to every path that
holds the blob. A second run over unchanged versions scans nothing.

Defined results: null text is the empty text; null ids are kept as they are; repeated rows give
repeated results but one scan; an empty table gives no rows and leaves the ledger alone; texts
are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.llm.common import text_or_empty
from lares.session import shared_dir

#: kind: (pattern, group whose length counts, least length), in the order that breaks ties.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: What stands between the lines of a key block without END line (also quoted or escaped in one line), and the header lines of any.
_GAP = r"""\x20\x09\x0A\x0D\\"',"""
_HEADERS = r"(?:[\x20\x09\x0A\x0D]*[A-Z][A-Za-z0-9-]*:[^\x0A\\]*(?:\x0A|\\n)){0,9}"
#: The body, whatever its quoting, up to the END line; without one, up to the last long run of base64 and one shorter run behind it.
_ENDED = r"[^-]*-----END [A-Z ]*PRIVATE KEY-----"
_OPEN = rf"(?:[A-Za-z0-9+/={_GAP}]*[A-Za-z0-9+/=]{{40,}}|[{_GAP}]*n?[A-Za-z0-9+/=]{{16,}})(?:[{_GAP}]+n?[A-Za-z0-9+/]+={{1,2}}|[\x20\x09\x0A\x0D\\]+[A-Za-z0-9+/]+)?"
#: Kinds beyond the base: key blocks with their body, three-part signed tokens, prefixed service tokens.
ADDED = {
    "pem": (rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_HEADERS}(?:{_ENDED}|{_OPEN}))?", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
}
RULES = BASE | ADDED
#: Every match of a kind holds one of these in its lower-cased text; others need no pattern search.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "pem": ("-----begin",), "jwt": ("eyj",), "forge": ("gh",)}
RULES_VERSION = "1.1"
LEDGER_SCHEMA = "blob string, rules string, spans array<struct<s:int,o:int,e:int>>"


def _kind_spans(order: int, kind: str) -> Column:
    """Spans of one kind as array<struct<s, o, e>>: code points, end exclusive, leftmost and non-overlapping.

    A pattern splits the text into the pieces between its matches, so running sums of the
    lengths of pieces and matches are the places of the matches.
    """
    pattern, group, least = RULES[kind]
    lit = F.lit(pattern)
    found = F.regexp_extract_all("_text", lit, F.lit(0))
    if kind in HINTS:
        hinted = F.lit(False)
        for h in HINTS[kind]:
            hinted = hinted | F.contains("_lower", F.lit(h))
    else:
        hinted = F.rlike("_text", lit)
    sizes = found if group == 0 else F.regexp_extract_all("_text", lit, F.lit(group))
    parts = F.arrays_zip(F.split("_text", pattern, -1).alias("gap"), found.alias("hit"), sizes.alias("value"))
    empty = f"CAST(array() AS array<struct<s:int,o:int,e:int>>)"
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr(empty).alias("out")),
        lambda a, p: F.struct(
            (a.at + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))).cast("int").alias("at"),
            F.when(F.length(p["value"]) >= least, F.concat(a.out, F.array(F.struct(
                (a.at + F.length(p["gap"])).cast("int").alias("s"), F.lit(order).alias("o"), (a.at + F.length(p["gap"]) + F.length(p["hit"])).cast("int").alias("e")))))
            .otherwise(a.out).alias("out")),
        lambda a: a.out,
    )
    return F.when(hinted, walked).otherwise(F.expr(empty))


def scan(blobs: DataFrame) -> DataFrame:
    """blob, rules, spans of every row of ``blobs`` (blob, _text)."""
    spans = [_kind_spans(i, kind) for i, kind in enumerate(RULES)]
    return blobs.withColumn("_lower", F.lower("_text")).select("blob", F.lit(RULES_VERSION).alias("rules"), F.array_sort(F.concat(*spans)).alias("spans"))


def findings(versions: DataFrame, ledger: str, key: str = "doc_id") -> DataFrame:
    """key, blob, spans for every row of ``versions`` (key, text); scans what ``ledger`` (a folder) lacks."""
    spark = versions.sparkSession
    named = versions.select(F.col(key), text_or_empty().alias("_text")).withColumn("blob", F.sha2("_text", 256))
    known = _read_ledger(spark, ledger)
    todo = named.select("blob", "_text")
    if known is not None:
        todo = todo.join(known.where(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    fresh = todo.groupBy("blob").agg(F.first("_text").alias("_text"))
    scan(fresh).write.mode("append").parquet(ledger)
    spans = _read_ledger(spark, ledger).where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    return named.select(key, "blob").join(spans, "blob", "left").select(key, "blob", F.coalesce("spans", F.expr("CAST(array() AS array<struct<s:int,o:int,e:int>>)")).alias("spans"))


def without_secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """``docs`` (text, n_chars and other columns) with every secret replaced by a mark."""
    spark = docs.sparkSession
    blob = F.sha2(text_or_empty(), 256)
    findings(docs, ledger)
    spans = _read_ledger(spark, ledger).where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("_spans"))
    marked = docs.withColumn("_blob", blob).join(spans.withColumnRenamed("blob", "_blob"), "_blob", "left")
    clean = marked.withColumn("_clean", F.when(F.col("_spans").isNotNull(), redacted(F.col("text"), F.col("_spans"))))
    fixed = {"text": F.coalesce("_clean", "text"), "n_chars": F.coalesce(F.length("_clean").cast("long"), "n_chars")}
    return clean.select(*[fixed.get(c, F.col(c)).alias(c) for c in docs.columns])


def _read_ledger(spark, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def new_ledger(spark) -> str:
    """A fresh ledger folder in the shared folder."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in span order."""
    kinds = F.array(*[F.lit(k) for k in RULES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.o + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts of the base kinds, the digest of their spans, and all spans."""
    base = F.filter("spans", lambda x: x.o < len(BASE))
    counts = [F.size(F.expr(f"filter(spans, x -> x.o = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans (sorted by start) replaced by one mark."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x.e <= a.at, a).otherwise(F.struct(
            x.e.alias("at"),
            F.when((x.s < a.at), a.out).otherwise(F.concat(a.out, F.substring(text, a.at + 1, x.s - a.at), F.lit(mark))).alias("out"))),
        lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))),
    )
