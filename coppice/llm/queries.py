"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, embedding_dedup, langid, licenses, mixing, packing, quality_model, quality_rules, secrets, simhash
from .common import fold, shared_dir, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.decisions(table(spark, sf_dir, "documents"))
    met = [F.round(f"met_{m}", 6).alias(f"met_{m}") for m in mixing.KEYS]
    return out.select("doc_id", "topic", F.col("tokens").alias("n_tokens"), F.round("rate", 6).alias("rate"), "kept", *met)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_attention_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round("js_char", 6).alias("js_char"), F.round("js_word", 6).alias("js_word"), "base_failed", "kept")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go into a new ledger; a second run over them meets a ledger that has seen every blob."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secrets.create_ledger(spark, path)
    for _ in range(2):
        secrets.append(docs, path, path="doc_id", content="text")
    found = secrets.findings(docs, secrets.read_ledger(spark, path), "doc_id", "text")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select(F.col("path").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, quality_model.training_labels(table(spark, sf_dir, "labels")))
    out = quality_model.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "queue", F.round("target", 6).alias("target"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.array_join("licenses", ",").alias("licenses"))


def op9_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_span_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(langid.training_rows(docs)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_simhash_near_dedup, op3_attention_lm_scores, op4_divergence_rules, op5_secret_ledger, op6_neighbour_quality, op7_mixture_packing, op8_license_dice, op9_embedding_cells, op10_span_language)
}

ORACLE: dict[str, str] = {"op1_mix_sources": mixing.oracle(), "op8_license_dice": licenses.oracle()}
