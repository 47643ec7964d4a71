"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html, langid, licenses, linedup, mixing, ngramjoin, oracles, substr, urlfilter
from ._util import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template_tokens")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify_by_own_labels(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.dedup_digest(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.RULES, urlfilter.BLOCKED_HOSTS).select("page_id", "host", "path", "rule", "verdict")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(1.0) + F.coalesce("quality", F.lit(0))).alias("weight"))
    return mixing.mix_sources(table(spark, sf_dir, "documents"), labels).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    base, found = F.col("base"), F.col("found")
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], found["label"])).alias("labels"),
        F.greatest(F.coalesce(F.array_max(found["weight"]), F.lit(0.0)), F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_line_dedup,
        op3_language_id,
        op4_decontamination,
        op5_substring_dedup,
        op6_nearest_neighbours,
        op7_ngram_jaccard_join,
        op8_url_filter,
        op9_source_mixing,
        op10_license_scan,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | {
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
        p AS (SELECT page_id,
                     translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        hosts(h) AS (VALUES ('adult-x.example.net'), ('cheap-pills.example.com'), ('free-bets.example.com'), ('spam-farm.example.org')),
        fit AS (SELECT page_id, max_by(rules.h || rules.p, length(rules.h || rules.p)) AS rule, max_by(rules.v, length(rules.h || rules.p)) AS v
                FROM p JOIN rules ON (p.host = rules.h OR p.host LIKE '%.' || rules.h) AND starts_with(p.path, rules.p) GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, fit.rule,
               CASE WHEN fit.v IS NOT NULL THEN fit.v
                    WHEN EXISTS (SELECT 1 FROM hosts WHERE p.host = hosts.h OR p.host LIKE '%.' || hosts.h) THEN 'block' ELSE 'allow' END AS verdict
        FROM p LEFT JOIN fit ON p.page_id = fit.page_id
    """,
}
