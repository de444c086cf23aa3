"""The thin queries over the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decontamination
from . import exact_dedup as exact
from . import filter_audit, jaccard_join, mixing, packing, periodic_runs, pii, quality, substring_dedup, suffix_dedup, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
#: The name of the vocabulary file in the installed collection of public tokenizers.
VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_removed")


def op5_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", removed(), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_columns(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op6_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", removed(), F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_columns(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_columns(found: DataFrame) -> DataFrame:
    has = lambda kind: lambda s: s["kind"] == F.lit(kind)
    counts = [F.size(F.filter("base", has(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_columns(pii.find_pii(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_columns(packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_VOCABULARY)))


def op13_columns(found: DataFrame) -> DataFrame:
    top = periodic_runs.strongest(F.col("runs"))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    flat = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return flat.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_columns(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

LOWER_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH sizes AS (
  SELECT source AS src, sum(CAST(strlen(coalesce(text, '')) AS DOUBLE)) AS size FROM documents GROUP BY source
), rates AS (
  SELECT src, 1.0 / (SELECT count(*) FROM sizes WHERE size > 0) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes WHERE size > 0
), steps AS (
  SELECT src, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY src ORDER BY k) AS c
  FROM (SELECT src, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM rates)
), drawn AS (
  SELECT d.*, (CAST('0x' || substr(md5('17|' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, CAST(count(*) AS INTEGER) AS n_copies FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.src AND s.c <= d.u GROUP BY d.doc_id
)
SELECT d.*, n_copies, CAST(copy_no AS INTEGER) AS copy_no, CAST('0x' || substr(md5('17|' || doc_id || '|' || copy_no), 1, 15) AS BIGINT) AS order_key
FROM (SELECT doc_id AS id, n_copies, unnest(generate_series(1, n_copies)) AS copy_no FROM counted) c JOIN documents d ON d.doc_id = c.id
"""

OP4_SQL = f"""
WITH n AS (SELECT doc_id, {LOWER_AZ} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM d WHERE len(words) >= 50
), w AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS k FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM w
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM m WHERE least < doc_id
), g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN words ELSE list_filter(words, lambda w, j: NOT list_contains(js, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER_AZ}, '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle FROM p
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array({LOWER_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), bw AS (
  SELECT item_id, words, unnest(generate_series(1, greatest(len(words) - 12, 1))) AS p FROM b WHERE len(words) > 0
), win AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(list_slice(words, p, p + 12), ' ') AS phrase FROM bw
), sizes AS (SELECT DISTINCT n FROM win
), dp AS (
  SELECT doc_id, n, words, unnest(generate_series(1, len(words) - n + 1)) AS p FROM d, sizes WHERE len(words) >= n
), dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(words, p, p + n - 1), ' ') AS phrase FROM dp
), hit AS (
  SELECT doc_id, item_id, p, n FROM dw JOIN win USING (n, phrase)
), spots AS (
  SELECT doc_id, count(DISTINCT s) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS s FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN spots ON d.doc_id = spots.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 50 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT) AS b,
    CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d,
    CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INT) AS e
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), g AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), names AS (
  SELECT unnest(range(5)) AS i
), orders AS (
  SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM names p, names q, names r, names s, names u
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i + 1 AS INT), 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), masks AS (
  SELECT filter_order, step, CAST(1 << o[step] AS INT) AS m, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM steps
), counted AS (
  SELECT part, filter_order, step, m,
    sum(CASE WHEN fails & (before | m) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & m > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & m > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = m THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & m > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & m > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, masks GROUP BY part, filter_order, step, m
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, m) AS BIGINT) AS shapley
FROM counted
"""

OP13_SQL = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), raw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, t
), placed AS (
  SELECT doc_id, words, len(words) AS n, h, h // 10 AS g, (h // 10) % greatest(len(words), 1) AS a FROM raw
), sized AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE words END AS words FROM sized
), w AS (
  SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM d
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p)
), runs AS (
  SELECT doc_id, s, len, min(p) AS p FROM stretches GROUP BY doc_id, s, len
), best AS (
  SELECT doc_id, s, len, p FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / p DESC, s, p) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS text FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(p AS BIGINT) AS period, CAST(1000 * len // p AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL, "op9_decontaminate": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_periodic_runs": OP13_SQL}
