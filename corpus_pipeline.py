"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.ranking import remove, shared_dir
from coppice.llm import langid, mixing, packing, secrets, simhash
from coppice.llm.common import fresh, made, release, table
from coppice.llm.queries import tokenizer_path

#: Documents whose language is less certain than this go.
LEAST_CERTAIN = 0.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a prevailing language."""
    model = langid.train(langid.training_rows(docs))
    good = langid.keep(docs, model, LEAST_CERTAIN)
    return good.select(docs.columns)


def _key(docs: DataFrame) -> Column:
    """What tells documents apart: the id, or the text where there is none."""
    none = F.col("doc_id").isNull()
    return F.struct(none.alias("none"), F.when(none, 0).otherwise(F.col("doc_id")).alias("id"), F.when(none, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).otherwise("").alias("text"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near-duplicates, one without an id only where no other has one.

    Rows that repeat an id, or lack one and repeat a text, are one document and stay together.
    """
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, _key(docs))
    first = simhash.near_duplicates(keyed, key).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(first, key, "left_semi").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; no document goes."""
    blob, spans = fresh(docs, "blob", "spans")
    ledger = secrets.scan(docs, path="doc_id", content="text")
    hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    marked = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(hits, blob, "left")
    found = F.col(spans).isNotNull()
    clean = {"text": F.when(found, secrets.redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        clean["n_chars"] = F.when(found, F.length(clean["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return marked.withColumns(clean).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by rates raked to tempered source, language and topic shares."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows; token ids are little-endian unsigned 32-bit numbers."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("secrets", redact), ("mixture", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and reread, and what it was made from is deleted then."""
    docs = table(spark, sf_dir, "documents")
    top, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path, since = f"{top}/{k}-{name}", made()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since)
        if before:
            remove(spark, before)
        before = path
    return docs
