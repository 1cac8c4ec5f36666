"""Quality rules whose cutoffs come from the data (operator 7). DataFrame functions only.

Every document is measured once. Per language and source, each measure is summarised by a
mergeable quantile sketch: a count per *sketch key*, where the key keeps the top six bits of
the integer measure (relative error at most 1/32). Sketches merge by adding counts, so partial
results combine on the map side and the sketch of a language, or of everything, is the sum of
the sketches of its sources. Quartiles read from the sketches give an upper fence per group,
and documents are joined with the fences of their group.

Defined results: null text counts as empty (no words, ``base_failed``); null language or source
is a group of its own; a group with fewer than ``min_group`` documents uses the sketch of its
language, and a small language that of the whole table; an empty table gives no rows; repeated
rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lares.llm.common import WORD, text_or_empty
from lares.session import cut

#: Base rule.
MIN_WORDS, WINDOW, REPEAT_PER_CENT = 10, 5, 20
#: Measures with a fence: expression over the measured row, and the least spread taken as normal.
MEASURES = {
    "symbols": ("n_symbols * 1000L div n_words", 40),
    "word_length": ("word_chars * 100L div n_words", 40),
    "dup_lines": ("n_dup_lines * 1000L div n_lines", 50),
    "repeats": ("n_repeat_words * 1000L div n_words", 20),
}
#: Fence: third quartile plus this many spreads.
SPREADS, MIN_GROUP, KEY_BITS = 8, 200, 6


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every whole text, one row per row of ``docs``."""
    text = docs.select("doc_id", "lang", "source", text_or_empty().alias("_text"))
    lines = "filter(split(_text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    hashed = text.select(
        "doc_id", "lang", "source",
        F.transform(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_h"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.expr(lines).alias("_lines"),
    )
    windows = hashed.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("_h").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_h) < 5 THEN array() ELSE transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i+1], _h[i+2], _h[i+3], _h[i+4])) END").alias("_w"),
    )
    return windows.select(
        "doc_id", "lang", "source", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("_w")) == F.size("_w"), F.lit(0).cast("long")).otherwise(_covered("_w")).alias("n_repeat_words"),
    )


def _covered(w: str) -> Column:
    """Words inside windows that occur twice or more, by one sort of the window hashes.

    Half of the hash and the position are packed in one long, so equal windows become
    neighbours in a primitive sort; neighbours are then compared by their whole hash.
    """
    packed = f"sort_array(transform({w}, (v, i) -> (v & -4294967296L) | CAST(i AS BIGINT)))"
    near = "filter({s}, (x, i) -> (i > 0 AND shiftright(x, 32) = shiftright({s}[greatest(i - 1, 0)], 32)) OR (i < size({s}) - 1 AND shiftright(x, 32) = shiftright({s}[least(i + 1, size({s}) - 1)], 32)))"
    # one-element transforms name intermediate arrays, so that each is computed once
    named = f"transform(array({packed}), s -> {near.format(s='s')})[0]"
    pairs = f"array_sort(transform({named}, x -> struct({w}[CAST(x & 4294967295L AS INT)] AS v, CAST(x & 4294967295L AS INT) AS p)))"
    same = "filter(s, (x, i) -> (i > 0 AND x.v = s[greatest(i - 1, 0)].v) OR (i < size(s) - 1 AND x.v = s[least(i + 1, size(s) - 1)].v))"
    places = f"sort_array(transform(transform(array({pairs}), s -> {same})[0], x -> x.p))"
    return F.expr(f"aggregate({places}, named_struct('n', 0L, 'last', -{WINDOW}), (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n)")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PER_CENT * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, key, n: the mergeable sketches of the documents that pass the base rule."""
    each = F.array(*[F.struct(F.lit(name).alias("measure"), F.expr(e).alias("value")) for name, (e, _) in MEASURES.items()])
    rows = measured.where(~base_failed()).select("lang", "source", F.inline(each))
    drop = F.greatest(F.length(F.bin("value")) - KEY_BITS, F.lit(0))
    key = F.expr("shiftleft(shiftright(value, _drop), _drop)")
    return rows.withColumn("_drop", drop).groupBy("lang", "source", "measure", key.alias("key")).agg(F.count("*").alias("n"))


def _quartile_fences(sketch: DataFrame, by: list[str], spreads: int) -> DataFrame:
    """by, measure, docs, fence: read from the running counts of the sketch's keys."""
    from pyspark.sql import Window

    group = [*by, "measure"]
    merged = sketch.groupBy(*group, "key").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group)
    running = merged.withColumn("_up_to", F.sum("n").over(w.orderBy("key"))).withColumn("_all", F.sum("n").over(w))
    least = F.lit(None)
    for name, (_, spread) in MEASURES.items():
        least = F.when(F.col("measure") == name, F.lit(spread)).otherwise(least)
    q = running.groupBy(*group).agg(
        F.max("_all").alias("docs"),
        F.min(F.when(4 * F.col("_up_to") >= F.col("_all"), F.col("key"))).alias("_q1"),
        F.min(F.when(4 * F.col("_up_to") >= 3 * F.col("_all"), F.col("key"))).alias("_q3"),
    )
    return q.select(*group, "docs", (F.col("_q3") + spreads * F.greatest(F.col("_q3") - F.col("_q1"), least)).alias("fence"))


def thresholds(measured: DataFrame, spreads: int = SPREADS, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and one fence column per measure."""
    sketch = cut(sketches(measured))
    own = _quartile_fences(sketch, ["lang", "source"], spreads)
    lang = _quartile_fences(sketch, ["lang"], spreads).select("lang", "measure", F.col("docs").alias("_ld"), F.col("fence").alias("_lf"))
    every = _quartile_fences(sketch, [], spreads).select("measure", F.col("fence").alias("_ef"))
    both = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
    both = both.select("o.lang", "o.source", "o.measure", "docs", "fence", "_ld", "_lf").join(every, "measure")
    fence = F.when(F.col("docs") >= min_group, F.col("fence")).when(F.col("_ld") >= min_group, F.col("_lf")).otherwise(F.col("_ef"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES])


def judged(docs: DataFrame, spreads: int = SPREADS, min_group: int = MIN_GROUP) -> DataFrame:
    """The measures of every document, base_failed, and kept: within every fence of its group."""
    measured = cut(measures(docs))
    fences = thresholds(measured, spreads, min_group).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"max_{m}" for m in MEASURES])
    joined = measured.join(fences, measured["lang"].eqNullSafe(F.col("_l")) & measured["source"].eqNullSafe(F.col("_s")), "left")
    inside = F.lit(True)
    for m, (e, _) in MEASURES.items():
        inside = inside & (F.expr(e) <= F.col(f"max_{m}"))
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         F.when(failed, F.lit(False)).otherwise(inside).alias("kept"))
