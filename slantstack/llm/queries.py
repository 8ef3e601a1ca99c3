"""The corpus operators as queries over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, line_dedup, mixing, multiset_hash, pseudo_likelihood, simhash, token_cache, url_filter
from .common import table

WIDTH = 10


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model, columns={"doc_id": F.col("doc_id"), "held_out": held_out})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=WIDTH)


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("row_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).withColumnRenamed("new_text", "text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(table(spark, sf_dir, "documents"))


#: Action, host, path prefix.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(list_slice(w, s, s + least(len(w), {WIDTH}) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS s FROM i WHERE len(w) > 0)),
places AS (
  SELECT r, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS p
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
met AS (SELECT r, item_id, k, s FROM places JOIN windows USING (k, p)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS x FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def _template_values() -> str:
    rows = [(label, text, True) for text, label in license_scan.BASE] + [(label, text, False) for label, text in license_scan.NOTICES]
    return ", ".join(f"({k}, '{label}', {base}, {_WORDS.format(repr(text))})" for k, (label, text, base) in enumerate(rows))


_OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM documents),
t AS (SELECT template, label, base, CAST(len(w) - 1 AS INT) AS size, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (VALUES {_template_values()}) v(template, label, base, w))),
g AS (SELECT r, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
votes AS (SELECT DISTINCT r, template, label, base, size, pos - tpos AS diagonal, tpos FROM g JOIN t USING (a, b)),
marked AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {license_scan.GAP}, true) THEN 1 ELSE 0 END AS apart
  FROM (SELECT DISTINCT r, template, label, base, size, diagonal FROM votes)),
spans AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked),
merged AS (SELECT r, template, label, base, size, span, min(diagonal) AS start, CAST(count(DISTINCT tpos) AS DOUBLE) / size AS cover FROM spans JOIN votes USING (r, template, label, base, size, diagonal) GROUP BY r, template, label, base, size, span),
good AS (SELECT * FROM merged WHERE cover >= CASE WHEN base OR size < {license_scan.SHORT} THEN 1 ELSE 0.6 END),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM good GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_decontaminate": op2_decontaminate,
        "op3_pseudo_likelihood": op3_pseudo_likelihood,
        "op4_license_scan": op4_license_scan,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_mix": op7_mix,
        "op8_line_dedup": op8_line_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_url_filter": op10_url_filter,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op4_license_scan": _OP4}
