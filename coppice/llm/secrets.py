"""Secret scans over a ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

RULE_VERSION = "1"


@dataclass(frozen=True)
class Rule:
    """``value_group`` must have ``least`` characters; shorter matches are consumed and dropped."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: What counts as a secret, in the order in which kinds are listed.
RULES = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
    Rule("pem", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def create_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger: a Parquet table in storage that all executors share."""
    spark.createDataFrame([], LEDGER).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def _none() -> Column:
    return F.array().cast(SPANS)


def _spans(text: Column, no: int, rule: Rule) -> Column:
    """array<struct(start, kind_no, kind, end)>: gaps between matches and matches give the code-point offsets."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m))
    value = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group)), lambda m: F.length(m))
    at = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), value.alias("value"))
    zero = F.struct(F.lit(0).alias("pos"), _none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        hit = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        keep = F.coalesce(x["value"] >= rule.least, F.lit(False))
        return F.struct(end.alias("pos"), F.when(keep, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(rule.pattern), F.aggregate(at, zero, step, lambda acc: acc["found"])).otherwise(_none())


def scan_text(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, i, r) for i, r in enumerate(rules)]))


def _versions(versions: DataFrame, path: str, content: str) -> DataFrame:
    return versions.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", content: str = "content", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, most_broadcast: int = 200_000) -> DataFrame:
    """The ledger's new rows (blob, rule_version, spans): every blob of ``versions`` that it lacks for this rule version.

    A version's blob is the sha256 of its content (null: empty).  Blobs are told apart by
    hash alone; the content of one version of each unseen blob is scanned, whatever its path, null
    too.  Up to ``most_broadcast`` unseen blobs (a checked size) are broadcast, and no other content is
    looked at; of more, contents that can't hold a secret are left out first and the others meet
    their blob in a shuffle.  A repeated path may bring several contents: each is a blob.
    """
    src = _versions(versions, path, content)
    at = src.select("path", F.sha2("content", 256).alias("blob"))
    fresh = at.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        fresh = fresh.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    fresh = cut(fresh)
    likely = "|".join(r.pattern for r in rules)
    f = fresh.select(F.col("blob").alias("own"), F.col("path").alias("at"))
    same = F.col("path").eqNullSafe(F.col("at")) & (F.sha2("content", 256) == F.col("own"))
    if fresh.limit(most_broadcast + 1).count() <= most_broadcast:
        # The condition on the joined column keeps the scan behind the join.
        one = src.join(F.broadcast(f), same).withColumn("content", F.when(F.col("own").isNotNull(), F.col("content")))
        one = one.where(F.col("content").rlike(likely)).withColumnRenamed("own", "blob")
    else:
        some = src.where(F.col("content").rlike(likely)).withColumn("blob", F.sha2("content", 256))
        one = some.join(f, (F.col("blob") == F.col("own")) & F.col("path").eqNullSafe(F.col("at")), "left_semi")
    hit = one.select("blob", scan_text(F.col("content"), rules).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["blob"])
    return fresh.join(hit, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", _none()).alias("spans"))


def append(versions: DataFrame, ledger_path: str, **how) -> None:
    """Scans what the ledger at the path hasn't seen, and adds it there.  Blobs that a rerun adds again do no harm."""
    spark = versions.sparkSession
    scan(versions, read_ledger(spark, ledger_path), **how).write.mode("append").parquet(ledger_path)


def findings(versions: DataFrame, ledger: DataFrame, path: str = "path", content: str = "content", rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) of every row of ``versions``, as its blob has them in the ledger; rows repeat as they do there."""
    at = _versions(versions, path, content).select("path", F.sha2("content", 256).alias("blob"))
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    return at.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", _none()).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each maximal run of overlapping spans replaced; spans sorted by start."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        fresh = s["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text)))))
