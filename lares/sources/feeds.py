"""Indicator feeds, masked delimited files, station feed and crawl rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lares.functions.exprs import parse_date_strict, parse_number, parse_number_ranged

# --- fixed values: envelope key -> (series, unit), plausible ranges, field-name tiers
ENVELOPES = {"UFs": ("uf", "CLP"), "UTMs": ("utm", "CLP"), "IPCs": ("ipc_var_m", "pct")}
PLAUSIBLE = {"uf": (20_000.0, 100_000.0), "utm": (40_000.0, 200_000.0), "ipc_var_m": (-5.0, 5.0)}
SERIES_CODES = {"UF": "uf", "UTM": "utm"}
VALUE_FIELDS = (("valor", "value", "monto"),)
DATE_FIELDS = (("fecha", "date"), ("fechaactualizacion", "fecha_actualizacion"))
CODE_FIELDS = (("codigo", "code"), ("moneda", "nombre", "name"))


def series_from_envelopes(docs: DataFrame) -> DataFrame:
    """Feed documents to long rows: series, day, value, unit, error.

    The series is named by the envelope key, not by the URL; an unknown envelope is an error
    row, never a mislabelled series.
    """
    item = "array<struct<Valor:string,Fecha:string>>"
    parsed = F.from_json("body", "struct<" + ",".join(f"{k}:{item}" for k in ENVELOPES) + ">")
    d = docs.withColumn("_p", parsed)
    known = [F.when(F.col(f"_p.{k}").isNotNull(), F.struct(F.lit(s).alias("series"), F.lit(u).alias("unit"), F.col(f"_p.{k}").alias("rows")))
             for k, (s, u) in ENVELOPES.items()]
    d = d.withColumn("_e", F.coalesce(*known))
    bad = d.where("_e is null").select("doc_id", F.lit(None).cast("string").alias("series"), F.lit(None).cast("date").alias("day"),
                                       F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("unknown_envelope").alias("error"))
    r = d.where("_e is not null").select("doc_id", "_e.series", "_e.unit", F.explode("_e.rows").alias("r"))
    value = F.replace(F.replace(F.trim("r.Valor"), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    day = F.col("r.Fecha").try_cast("date")
    ok = r.select("doc_id", "series", day.alias("day"), value.alias("value"), "unit",
                  F.when(value.isNull() | day.isNull(), "bad_record").alias("error"))
    return ok.unionByName(bad)


def tiered_field(record: Column, tiers) -> tuple[Column, Column]:
    """(value, error): first tier present wins; two names of one tier in a record are an error."""
    norm = F.transform_keys(record, lambda k, v: F.replace(F.lower(F.trim(k)), F.lit(" "), F.lit("")))
    value, error = F.lit(None).cast("string"), F.lit("missing")
    for names in reversed(tiers):
        hits = F.array_compact(F.array(*[F.when(F.map_contains_key(norm, n), F.struct(F.element_at(norm, n).alias("v"))) for n in names]))
        value = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["v"]).when(F.size(hits) > 1, F.lit(None)).otherwise(value)
        error = F.when(F.size(hits) == 1, F.lit(None).cast("string")).when(F.size(hits) > 1, "ambiguous").otherwise(error)
    return value, error


def series_from_records(docs: DataFrame) -> DataFrame:
    """Records with unstable field names and ambiguous numbers to typed rows with a reject reason."""
    rec = F.from_json("body", "map<string,string>")
    code, e1 = tiered_field(rec, CODE_FIELDS)
    raw, e2 = tiered_field(rec, VALUE_FIELDS)
    date, e3 = tiered_field(rec, DATE_FIELDS)
    codes = F.create_map(*[F.lit(x) for kv in SERIES_CODES.items() for x in kv])
    d = docs.select("doc_id", codes[F.upper(F.trim(code))].alias("series"), raw.alias("raw"), date.alias("date"),
                    F.coalesce(e1, F.when(e2.isNotNull(), e2), F.when(e3.isNotNull(), e3)).alias("_e"))
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for s, (a, b) in PLAUSIBLE.items():
        lo, hi = F.when(F.col("series") == s, a).otherwise(lo), F.when(F.col("series") == s, b).otherwise(hi)
    value, day = parse_number_ranged(F.col("raw"), lo, hi), parse_date_strict(F.col("date"))
    err = F.coalesce("_e", F.when(value.isNull(), "bad_number"), F.when(day.isNull(), "bad_date"))
    return d.where(F.col("series").isNotNull() | F.col("_e").isNotNull()).select(
        "doc_id", "series", value.alias("value"), day.alias("day"), err.alias("error"))


# ----------------------------------------------------------------- masked delimited files


def census_reader(spark, path: str, columns: list[str]) -> DataFrame:
    """Semicolon file read as text only; ``*`` is a masked value and becomes NULL."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.option("sep", ";").option("header", True).option("nullValue", "*").schema(schema).csv(path)


def typed(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """Explicit casts of text columns: source -> (target, text|int|decimal). Empty and ``*`` are NULL."""
    out = []
    for src, (dst, kind) in mapping.items():
        t = F.nullif(F.nullif(F.trim(F.col(src)), F.lit("")), F.lit("*"))
        if kind == "int":
            t = t.try_cast("int")
        elif kind == "decimal":
            t = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
        out.append(t.alias(dst))
    return df.select(*out)


# ----------------------------------------------------------------- stations


def classify_stations(elements: DataFrame, now: Column, lines_building: list[str]) -> DataFrame:
    """Map elements (id, type, tags, lat, lon) to stations with network, line, status and opening year.

    ``outcome`` says what happened to every element: station, off_network, unclassified,
    unnamed or route.
    """
    tag = lambda k: F.element_at("tags", F.lit(k))
    has = lambda k: F.map_contains_key("tags", k)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    years = [F.substring(F.trim(tag(k)), 1, 4) for k in ("opening_date", "start_date")]
    year = F.coalesce(*[F.when(y.rlike(r"^\d{4}$"), y.cast("int")) for y in years])
    future = F.lit(None).cast("boolean")
    for k in ("start_date", "opening_date"):
        v = F.trim(tag(k))
        full = v.try_cast("date")
        is_full = v.rlike(r"^\d{4}-\d{2}-\d{2}$") & full.isNotNull()
        y = F.substring(v, 1, 4)
        future = F.when(is_full, full > now).when(y.rlike(r"^\d{4}$"), y.cast("int") > F.year(now)).otherwise(future)
    future = F.coalesce(future, F.lit(False))
    subway = F.lit(False)
    for k in ("station", "construction:station", "proposed:station"):
        subway = subway | F.coalesce(tag(k) == "subway", F.lit(False))
    net_text = F.concat_ws(" ", low(tag("network")), low(tag("operator")))
    on_network = subway | F.coalesce(tag("subway") == "yes", F.lit(False)) | net_text.contains("metro de santiago") | net_text.contains("biotr")
    eq = lambda k, v: F.coalesce(tag(k) == v, F.lit(False))
    building = eq("railway", "construction") | eq("construction", "station") | has("construction:railway") | has("construction:station")
    proposed = eq("railway", "proposed") | eq("proposed", "station") | has("proposed:railway") | has("proposed:station") | has("proposed:public_transport")
    now_open = eq("railway", "station")
    known = now_open | eq("station", "subway") | building | proposed | year.isNotNull()
    status = F.when(now_open & ~future, "open").when(building, "building").when(proposed | future, "proposed").otherwise("open")
    net = F.trim(F.coalesce(tag("network"), F.lit("")))
    raw_line = F.when(F.lower(net).rlike("^l[íi]nea"), net).otherwise(F.coalesce(tag("ref"), tag("line"), tag("subway_line")))
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw_line)), "l[íi]nea", "l"), " ", "")
    line = F.when(F.coalesce(flat, F.lit("")) != "", F.when(flat.startswith("l"), flat).otherwise(F.concat(F.lit("l"), flat)))
    status = F.when((status == "proposed") & line.isin(lines_building) & year.isNotNull(), "building").otherwise(status)
    network = F.when(low(tag("network")).contains("biotr"), "biotren").when(eq("train", "yes") | low(tag("network")).contains("melipilla"), "efe").otherwise("metro-santiago")
    outcome = (F.when((F.col("type") == "relation") & has("route"), "route").when(~on_network, "off_network").when(~known, "unclassified")
               .when(tag("name").isNull() | F.col("lat").isNull() | F.col("lon").isNull(), "unnamed").otherwise("station"))
    # of an element that came twice the row of the smallest name, place and tags counts
    rest = [c for c in elements.columns if c not in ("type", "id")]
    first = F.min_by(F.struct(*rest), F.struct("lat", "lon", F.array_sort(F.map_entries("tags"))))
    once = elements.groupBy("type", "id").agg(first.alias("_e")).select("type", "id", "_e.*")
    return once.select(
        "id", "type", tag("name").alias("name"), network.alias("network"), line.alias("line"), status.alias("status"), "lat", "lon",
        year.alias("opening_year"), outcome.alias("outcome"))


def collapse_stations(stations: DataFrame, degrees: float = 0.003) -> DataFrame:
    """One row per physical stop: a twin (same name, network, line, status within ~300 m) is dropped.

    A dated row is preferred to an undated one, then the smaller id. Stations meet only in a grid
    cell of that width and its neighbours, so a name that many stops share costs its neighbourhoods.
    """
    s = stations.where("outcome = 'station'")
    cell = lambda c: F.floor(F.col(c) / degrees)
    keys = ["name", "network", "status", F.coalesce("line", F.lit("")).alias("_line"), F.col("line").isNull().alias("_no_line")]
    rank = F.struct(F.col("opening_year").isNull().alias("undated"), "id")
    b = s.select(*keys, cell("lat").alias("_y"), cell("lon").alias("_x"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), rank.alias("_better"))
    near = F.array(*[F.struct((cell("lat") + i).alias("_y"), (cell("lon") + j).alias("_x")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = s.select("id", *keys, "lat", "lon", rank.alias("_own"), F.explode(near).alias("_c")).select("*", "_c._y", "_c._x").drop("_c")
    on = ["name", "network", "status", "_line", "_no_line", "_y", "_x"]
    twin = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [
        F.abs(F.col("a.lat") - F.col("b._lat")) < degrees, F.abs(F.col("a.lon") - F.col("b._lon")) < degrees, F.col("b._better") < F.col("a._own")], "left_semi")
    return s.join(twin.select("id").distinct(), "id", "left_anti")


# ----------------------------------------------------------------- crawl permission rules


_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def rule_lines(files: DataFrame) -> DataFrame:
    """host, block, field, value: the ``field: value`` lines of every rules file, comments removed.

    Lines that name agents directly after one another open one block together; lines before
    the first agent are in block 0, which nobody's rules come from.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = files.select("host", F.posexplode(F.split("text", _LINE_END)).alias("at", "line"))
    bare = lines.select("host", "at", F.regexp_replace("line", "#.*$", "").alias("line")).where(F.contains("line", F.lit(":")))
    pairs = bare.select("host", "at", F.lower(strip(F.substring_index("line", ":", 1))).alias("field"), strip(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    in_file = Window.partitionBy("host").orderBy("at")
    opens = (F.col("field") == "user-agent") & ~F.lag(F.col("field") == "user-agent", 1, False).over(in_file)
    return pairs.withColumn("_opens", opens.cast("int")).select("host", F.sum("_opens").over(in_file).cast("int").alias("block"), "field", "value")


def pattern_regex(pattern: Column) -> Column:
    """Rule pattern to an anchored regular expression: ``*`` any run, final ``$`` end of path."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(body, r"([\\.+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def rules_for_agent(files: DataFrame, agent: str) -> DataFrame:
    """host, rules: the rules of the most specific group that names the agent, else of ``*``.

    One array per host: a rules file is a small document.
    """
    lines = rule_lines(files)
    name = F.lower("value")
    fit = F.when(name == "*", 0).when(F.contains(F.lit(agent.lower()), name), F.length("value"))
    named = lines.where("field = 'user-agent'").select("host", "block", fit.alias("_fit")).where("_fit is not null")
    best = named.groupBy("host").agg(F.max_by("block", F.struct("_fit", -F.col("block"))).alias("block"))
    # an empty "disallow" forbids nothing
    paths = lines.where("field = 'allow' or (field = 'disallow' and value <> '')").select("host", "block", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    rules = paths.join(best, ["host", "block"])
    one = F.struct(F.length("pattern").alias("len"), F.col("allow"), F.col("pattern"), pattern_regex(F.col("pattern")).alias("regex"))
    return rules.groupBy("host").agg(F.collect_list(one).alias("rules"))


def url_verdicts(urls: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """Longest matching pattern wins, a tie goes to allow; no rule means allowed.

    URLs join one row per host and are never multiplied by rules.
    """
    rules = rules_for_agent(files, agent)
    path = F.regexp_replace(F.col("url"), r"^[a-z]+://[^/]*", "")
    path = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"#.*$", ""))
    j = urls.withColumn("path", path).join(rules, "host", "left")
    hit = F.array_max(F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"])))
    return j.withColumn("_w", hit).select(*urls.columns, F.coalesce("_w.allow", F.lit(True)).alias("allowed"), F.col("_w.pattern").alias("rule"))


def month_windows(ranges: DataFrame, months: int) -> DataFrame:
    """Split [start, end] month ranges into windows of at most ``months`` months."""
    start = F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {months} MONTHS"))).alias("window_start")
    w = ranges.select(*[c for c in ranges.columns if c not in ("start",)], start)
    return w.withColumn("window_end", F.least(F.add_months("window_start", months - 1), "end")).drop("end")
