"""One query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    audit, decontaminate, hosts, language, mixing, pages, periodic, simhash, suffixes, tokens, topk, unigram, windows,
)
from pulsegrid.workspace import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(table(spark, sf_dir, "documents"))
    return plan.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs)
    return found.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 400)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.digests(tokens.read(spark, path))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_windows(table(spark, sf_dir, "documents"), 13)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules of the URL filter.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, a tenth of the documents (by their id's checksum) with a periodic end."""
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    named = docs.selectExpr("doc_id", "text", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) AS h")
    cut = named.selectExpr("doc_id", "text", "h div 10 AS g", f"IF(h % 10 = 0, {words}, NULL) AS w")
    sized = cut.selectExpr("*", "CAST(g % nullif(size(w), 0) AS INT) AS a").selectExpr(
        "*", "1 + CAST(floor((size(w) - a) / (3 + g % 8)) AS INT) AS p"
    )
    planted = "array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ')"
    return sized.selectExpr("doc_id", f"IF(size(w) > 0, {planted}, text) AS text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_periods(table(spark, sf_dir, "documents")))
    # greatest length / period compared by cross products, exactly; runs come by start, then period
    better = "r.length * b.period > b.length * r.period"
    best = f"aggregate(slice(runs, 2, size(runs)), runs[0], (b, r) -> IF({better}, r, b))"
    lines = r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.selectExpr("*", f"IF(size(runs) > 0, {best}, NULL) AS best").selectExpr(
        "doc_id", "CAST(size(runs) AS LONG) AS n_runs", "best.start", "best.length", "best.period",
        "1000 * best.length div best.period AS exponent_milli",
        f"sha2({lines}, 256) AS runs_sha256", "sha2(kept, 256) AS collapsed_sha256",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_mix_sources, op3_page_text, op4_language, op5_top_k, op6_suffix_dedup, op7_token_files,
        op8_window_dedup, op9_simhash, op10_decontaminate, op11_url_filter, op12_periodic_runs, op13_filter_audit,
    )
}
