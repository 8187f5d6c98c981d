"""The registered queries ``opN_<name>``: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    collocation, divergence, kd_search, lang_id, license_scan, line_dedup, lm_score, mixing, quality, simhash, sp_sample, span_dedup,
    url_filter,
)
from tallyspark.llm.common import crc_remainder

#: The rules that the query has to apply, longest wins.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

#: Where no rule fits: hosts of adult, gambling and pharmacy pages, log-in pages, and files that aren't pages.
URL_GLOBS = (
    "*.adult*#*", "*casino*#*", "*cheap-pills*#*", "*porn*#*", "*viagra*#*",
    "*#*/login*", "*#*/wp-admin/*", "*#*/cart/*", "*#*.exe", "*#*.zip", "*#*.jpg", "*#*.png", "*#*.mp4",
)

#: A public SentencePiece model with byte fallback; only the driver reads the file.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and backoff scores of every document; those with remainder 2 are held out from training."""
    remainder = crc_remainder(F.col("doc_id"), 7)
    scored = lm_score.score(_table(spark, sf_dir, "documents", "doc_id", "text"), remainder != 2)
    return scored.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every document, with their places."""
    found = license_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    licenses = F.concat(license_scan.fullest(F.col("matches"))["license"], "short_matches.license")
    return found.select("doc_id", (F.size("matches") + F.size("short_matches")).cast("long").alias("n_matches"),
                        F.array_sort(F.array_distinct(licenses)).alias("licenses"), "matches", "short_matches")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products, among all vectors, of every vector whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return kd_search.top_k(vectors, 5, F.col("vec_id") % 50 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    return url_filter.judge(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, URL_GLOBS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; those with remainder 0 are held out from training."""
    documents = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = crc_remainder(F.col("doc_id"), 5)
    model = lang_id.train(documents.filter(remainder != 0))
    predicted = documents.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
                                 lang_id.predict_column(F.col("text"), model).alias("p"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines dropped, and a digest of the remaining text."""
    deduped = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return deduped.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdicts of two policies for every document."""
    written = quality.ledger(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return written.select(
        "doc_id", *[f"_measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("failed_bits"), (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STANDARD).alias("kept"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different segmentations of every document, with their scores and whether they decode to its text."""
    encoded = sp_sample.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)
    return encoded.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "ids", "log_prob", "key", "inclusion",
                          "round_trip")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    queued = mixing.queue(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return queued.select("doc_id", "size", "source_size", "target", "copies",
                         (F.col("size") * F.col("copies")).alias("taken"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, those that repeated passages cover, and a digest of the rest."""
    found = span_dedup.remove_repeated(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("_row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), "spans")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of a language against all others, and the terms it uses above the language's share."""
    return divergence.ranked(divergence.audit(_table(spark, sf_dir, "documents", "text", "lang", "source")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of two or three words of each language that hold together best."""
    return collocation.collocations(_table(spark, sf_dir, "documents", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_score, op2_license_scan, op3_topk_search, op4_url_filter, op5_language_id, op6_line_dedup,
                            op7_quality_rules, op8_sentencepiece, op9_mixing, op10_simhash, op11_span_dedup, op12_divergence, op13_collocations)
}
