"""What the first review found missing in op4: fails on the code that did less."""

import collections
import inspect

import pytest
from pyspark.sql import functions as F

from coppice.llm import quality_rules

NAMES = ["the", "of", "and", "to", "in", "is", "it", "on", "as", "at", "by", "or", "be", "we", "he", "an", "so", "if", "no", "up", "zz"]


def test_common_words_ignore_case(spark):
    plain = " ".join(w for k, w in enumerate(NAMES) for _ in range(40 - k))
    rows = [(1, plain * 1, "en"), (2, plain.upper(), "en"), (3, plain.title(), "en"), (4, " ".join(f"Q{i % 97}" for i in range(200)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality_rules.common_words(docs, least_words=100).collect()
    assert refs[0]["common"] == NAMES[:20]  # twenty, in lower case
    got = {r["doc_id"]: r["js_word"] for r in quality_rules.judge(docs.union(docs)).collect()}
    assert got[1] == pytest.approx(got[2]) == pytest.approx(got[3])
    assert got[4] > got[1]


def test_every_common_word_is_counted(spark):
    """Each of twenty, whether the words of all languages are given or not."""
    assert inspect.signature(quality_rules.judge).parameters["common"].default == 20
    text = " ".join(w for k, w in enumerate(NAMES) for _ in range(40 - k))
    docs = spark.createDataFrame([(1, text, "en"), (2, text.upper() + " ! @ A B", "en")], "doc_id long, text string, lang string")
    refs = quality_rules.common_words(docs, least_words=100)
    c = collections.Counter(text.split(" "))
    for known in (None, [*NAMES, "another"]):
        for row in quality_rules.with_hits(quality_rules.base_counts(docs).join(refs, "lang"), 20, known).collect():
            assert row["common"] == NAMES[:20] and row["hits"] == [c[w] for w in NAMES[:20]]


def test_counters_hold_more_than_two_million(spark):
    """A counter that carries into its neighbour's would show here."""
    n = (1 << 21) + 5
    df = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("common"), F.array_repeat(F.lit("a"), n).alias("words"), F.array_repeat(F.lit("a"), n).alias("low"))
    assert quality_rules.with_hits(df, 2).first()["hits"] == [n, 0]
