"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import byte_bpe, centroids, decontaminate, near_dups, pii, quality_model, quality_rules, token_files, toxicity, trie_bpe, url_filter, vector_codes, warc
from punctual.llm.common import new_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.digest(warc.read_archives(spark, path))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter.judged(table(spark, sf_dir, "pages"), outcomes)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_model.judged(table(spark, sf_dir, "documents"), trusted)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.token_file_digest(spark, path)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality_rules, op2_warc, op3_url_filter, op4_quality_model, op5_token_files, op6_near_duplicates, op7_toxicity, op8_pii, op9_bpe_round_trip, op10_decontamination, op11_byte_bpe, op12_centroids, op13_vector_codes, pipeline]
    return {f.__name__: f for f in named}


_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
win AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS win FROM w, unnest(range(1, len(w) - 1)) AS u(k) WHERE len(w) > 2),
again AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM again, unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS capitals
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * capitals > 30 * word_chars) AS kept
FROM m
"""


def _strength(rows: str) -> str:
    """The prior strength of a level, from rows (n, bad, p)."""
    x = f"(SELECT sum(n * (bad / n - p) ** 2) AS s, sum(p * (1 - p)) AS k, sum(n * p * (1 - p)) AS m FROM ({rows}) WHERE n > 0)"
    over = "CASE WHEN m > k THEN (s - k) / (m - k) ELSE 0 END"
    return f"SELECT least(1000.0, greatest(1.0, CASE WHEN {over} > 0 THEN 1 / ({over}) - 1 ELSE 1000.0 END)) AS k FROM {x}"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_ORDERED = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))
OP3 = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
l AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels GROUP BY 1),
h0s AS (SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS host, bad FROM u LEFT JOIN l USING (page_id) WHERE host <> ''),
h1 AS (SELECT host, string_split(host, '.') AS p, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM h0s GROUP BY host),
h2 AS (SELECT *, CASE WHEN len(p[-1]) = 2 AND coalesce(p[-2] IN ({', '.join(f"'{x}'" for x in url_filter.SECOND_LEVEL)}), false) THEN 1 ELSE 0 END AS more FROM h1),
h AS (SELECT host, n, bad, array_to_string(CASE WHEN more = 1 THEN p[-3:] ELSE p[-2:] END, '.') AS domain, array_to_string(CASE WHEN more = 1 THEN p[-2:] ELSE p[-1:] END, '.') AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + {url_filter.PRIOR_BAD}) / (coalesce(sum(n), 0) + {url_filter.PRIOR_PAGES}) FROM h) AS p FROM d GROUP BY suffix),
ks AS ({_strength('SELECT n, bad, p FROM s0')}),
s AS (SELECT suffix, (k * p + bad) / (k + n) AS mean FROM s0, ks),
d0 AS (SELECT domain, n, bad, s.mean AS p FROM d JOIN s USING (suffix)),
kd AS ({_strength('SELECT n, bad, p FROM d0')}),
d1 AS (SELECT domain, (k * p + bad) / (k + n) AS mean FROM d0, kd),
h0 AS (SELECT host, n, bad, d1.mean AS p FROM h JOIN d1 USING (domain)),
kh AS ({_strength('SELECT n, bad, p FROM h0')}),
post AS (SELECT host, (k * p + bad) / (k + n) AS mean, k + n + 1 AS more FROM h0, kh),
bad AS (SELECT host FROM post WHERE mean - {url_filter.BOUND_SD} * sqrt(mean * (1 - mean) / more) > {url_filter.BAD_LIMIT})
SELECT page_id, host, path, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _ORDERED)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _ORDERED)} WHEN regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[k:k + 12], ' ') AS win, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
hit AS (SELECT doc_id, k, g.n, item FROM g JOIN p ON g.win = p.win AND g.n = p.n),
cover AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(0, n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


_KEPT = "SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
_SQUARED = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
#: Of whole numbers, rounded down.
_MEAN = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"


def _lloyd(rounds: int = 5) -> str:
    parts = [f"k AS MATERIALIZED ({_KEPT.format(scale=256)})", "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 40)"]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': {_SQUARED.format(a='k.v', b='c.v')}, 'c': c.c}}) AS best FROM k, c{n} c GROUP BY r)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT best.c AS c, i, {_MEAN} AS x FROM (SELECT best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n} JOIN k USING (r)) GROUP BY ALL) GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN k USING (r) JOIN c{rounds} c ON c.c = best.c"""


def _codes(rounds: int = 4) -> str:
    parts = [f"k AS MATERIALIZED ({_KEPT.format(scale=1024)})", "x AS MATERIALIZED (SELECT r, p, v[16 * p + 1 : 16 * p + 16] AS v FROM k, range(4) AS u(p))"]
    parts.append("c0 AS MATERIALIZED (SELECT p, e, x.v FROM (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 256) JOIN x USING (r))")
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, p, min({{'d': {_SQUARED.format(a='x.v', b='c.v')}, 'e': e}}) AS best FROM x JOIN c{n} c USING (p) GROUP BY r, p)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT p, e, list(x ORDER BY i) AS v FROM (SELECT p, best.e AS e, i, {_MEAN} AS x FROM (SELECT p, best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n} JOIN x USING (r, p)) GROUP BY ALL) GROUP BY p, e)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (p, e))")
    return f"""WITH {', '.join(parts)},
rows AS (SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM rows JOIN k USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_url_filter": OP3, "op6_near_duplicates": OP6, "op10_decontamination": OP10, "op12_centroids": _lloyd(), "op13_vector_codes": _codes()}
