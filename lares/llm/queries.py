"""The registered queries of this subpackage, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lares.llm import chat, collocations, hardneg, langid, lbl_lm, packing, permindex, quality, relative_lz, secrets, shards, sigtree, trie_bpe
from lares.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLE[fn.__name__] = sql.strip()
    return fn


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


_FENCE_CASES = "\n".join(
    f"SELECT lang, source, '{m}' AS measure, {e.replace('1000L div', '1000 //').replace('100L div', '100 //')} AS value, {least} AS least FROM passed" + (" UNION ALL" if i < len(quality.MEASURES) - 1 else "")
    for i, (m, (e, least)) in enumerate(quality.MEASURES.items()))

query(op7_quality_rules, rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, p, array_to_string(ws[p:p + 4], ' ') AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, v) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(ws) AS n_words, len(ls) AS n_lines,
             length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
passed AS (SELECT * FROM b WHERE NOT base_failed),
v AS ({_FENCE_CASES}),
k AS (SELECT lang, source, measure, least, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS key FROM v),
levels AS (SELECT 0 AS level, lang, source, measure, least, key FROM k UNION ALL SELECT 1, lang, NULL, measure, least, key FROM k UNION ALL SELECT 2, NULL, NULL, measure, least, key FROM k),
counted AS (SELECT level, lang, source, measure, least, key, count(*) AS n FROM levels GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY key) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM counted),
q AS (SELECT level, lang, source, measure, least, max(total) AS docs, min(key) FILTER (4 * upto >= total) AS q1, min(key) FILTER (4 * upto >= 3 * total) AS q3 FROM running GROUP BY ALL),
f AS (SELECT level, lang, source, measure, docs, q3 + {quality.SPREADS} * greatest(q3 - q1, least) AS fence FROM q),
chosen AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.docs >= {quality.MIN_GROUP} THEN o.fence WHEN l.docs >= {quality.MIN_GROUP} THEN l.fence ELSE e.fence END AS fence
           FROM f o JOIN f l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure JOIN f e ON e.level = 2 AND e.measure = o.measure WHERE o.level = 0),
fences AS (SELECT lang, source, {', '.join(f"max(fence) FILTER (measure = '{x}') AS max_{x}" for x in quality.MEASURES)} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN FALSE ELSE {' AND '.join(f"{e.replace('1000L div', '1000 //').replace('100L div', '100 //')} <= max_{x}" for x, (e, _) in quality.MEASURES.items())} END AS kept
FROM b LEFT JOIN fences ON b.lang IS NOT DISTINCT FROM fences.lang AND b.source IS NOT DISTINCT FROM fences.source
""")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.conflicting(spark))
    return chat.digest(chat.verified(chat.formatted(rows)))


query(op9_chat_format, r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, CASE role WHEN 'assistant' THEN 9 WHEN 'user' THEN 13 ELSE 14 + length(role) END
              + length(text) + CASE WHEN contains(text, '\') OR contains(text, CASE role WHEN 'assistant' THEN '</s>' WHEN 'user' THEN '[/INST]' ELSE '[/ROLE]' END)
                                    THEN length(regexp_replace(text, '[^\\\[\]<>]+', '', 'g')) ELSE 0 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
""")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.findings(table(spark, sf_dir, "documents"), secrets.new_ledger(spark)))


_SPLIT = " UNION ALL ".join(
    f"SELECT r, {i} AS o, '{k}' AS kind, {least} AS least, string_split_regex(x, '{p.replace(chr(39), chr(39) * 2)}') AS gaps, regexp_extract_all(x, '{p.replace(chr(39), chr(39) * 2)}') AS hits, regexp_extract_all(x, '{p.replace(chr(39), chr(39) * 2)}', {g}) AS vals FROM t"
    for i, (k, (p, g, least)) in enumerate(secrets.RULES.items()))

query(op10_secret_scan, rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
s AS ({_SPLIT}),
h AS (SELECT r, o, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM s WHERE len(hits) > 0),
p AS (SELECT r, o, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS a, length(hits[i]) AS n FROM h WHERE length(vals[i]) >= least),
j AS (SELECT r, string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, o) AS spans,
             string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, o) FILTER (o < 3) AS base,
             count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2 FROM p GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (r)
""")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.joined(table(spark, sf_dir, "documents"))


query(op8_ngram_jaccard_join, r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, v FROM (
        SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM t WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.v = b.v AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM t JOIN r ON r.a = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
""")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encoded(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.scored(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shards.new_folder(spark)
    shards.write(table(spark, sf_dir, "documents"), folder)
    return shards.listed(spark, folder)


for _fn in (op1_best_fit_packing, op2_nearest_neighbours, op3_training_order_shards, op4_bpe_encoding, op5_language_id, op6_lm_scoring):
    query(_fn)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


query(op13_hard_negatives, r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
      FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, br, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id) <= 3
""")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.deduplicated(table(spark, sf_dir, "documents"))


query(op11_substring_dedup, r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, doc_id, p, hash(array_to_string(w[p:p + 19], ' ')) AS h, md5(array_to_string(w[p:p + 19], ' ')) AS m FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM t WHERE len(w) >= 20)),
d AS (SELECT r, p FROM v QUALIFY row_number() OVER (PARTITION BY h, m ORDER BY doc_id, r, p) > 1),
c AS (SELECT DISTINCT r, p + k AS p FROM d, (SELECT unnest(range(0, 20)) AS k)),
g AS (SELECT r, count(*) AS n, list(p) AS ps FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed,
       sha256(CASE WHEN g.n IS NULL THEN array_to_string(w, ' ') WHEN g.n = len(w) THEN '' ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(g.ps, i)), ' ') END) AS kept_sha256
FROM t LEFT JOIN g USING (r)
""")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


query(op12_collocations, r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph, w[i:i + k - 1] AS ws FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, ph, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY lang, k, ph),
c AS (SELECT * FROM f WHERE f >= 100 AND k > 1),
longer AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, array_to_string(ws[:k - 1], ' ') AS sub FROM c WHERE k > 2 UNION ALL SELECT lang, f, array_to_string(ws[2:], ' ') FROM c WHERE k > 2) GROUP BY lang, sub),
kept AS (SELECT c.* FROM c LEFT JOIN longer ON longer.lang = c.lang AND longer.sub = c.ph WHERE longer.f IS NULL OR 100 * c.f > 100 * longer.f),
cuts AS (SELECT kept.lang, ph, ws, f, unnest(range(1, k)) AS j FROM kept),
s AS (SELECT cuts.lang, cuts.ph AS phrase, cuts.f AS a, x.f AS l, y.f AS r, tot.n::BIGINT AS n, j, ((1000::HUGEINT * cuts.f * tot.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts JOIN tot ON tot.lang = cuts.lang JOIN f x ON x.lang = cuts.lang AND x.ph = array_to_string(cuts.ws[:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.ph = array_to_string(cuts.ws[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
