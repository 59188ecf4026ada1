"""CSV and LIBSVM text as tables of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Data

#: A number, or a missing one.
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$|^[-+]?(inf|infinity)$|^[-+]?nan$"


def roles(n_columns: int, label: int, weight: int = -1, ignored: list[int] | None = None) -> list[int]:
    """Positions of the features: file order without label, weight and ignored columns."""
    for c in (label, *([weight] if weight >= 0 else []), *(ignored or [])):
        if not 0 <= c < n_columns:
            raise ValueError(f"column {c} is not among {n_columns}")
    if weight == label:
        raise ValueError("label and weight are one column")
    return [i for i in range(n_columns) if i not in {label, weight, *(ignored or [])}]


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r"))


def _lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """The lines that aren't blank, without the first of each file if that is a header: it goes by its place, not by what it says."""
    if not header:
        return spark.read.text(path).where(F.length(_trim(F.col("value"))) > 0)
    reader = spark.read.schema("value string").options(sep="\x01", quote="", header=True, enforceSchema=True)
    return reader.csv(path).where(F.length(_trim(F.col("value"))) > 0)


def read_csv(spark: SparkSession, path: str, config: Data | None = None) -> DataFrame:
    """label, weight (if any) and the features, by name or f0, f1, ...; all floats.

    Fields are cut at commas and trimmed; there is no quoting and blank lines are
    skipped.  ``nan`` in any case is missing; an empty or other field raises an error
    that names the line, as does a line of another width.  Ignored columns are checked too.
    """
    cfg = config or Data()
    lines = _lines(spark, path)
    head = lines.limit(1).collect()
    if not head:
        raise ValueError(f"{path} has no rows" if not cfg.header else f"{path} has no header")
    first = [x.strip(" \t\r") for x in head[0]["value"].split(",")]
    width = len(first)
    names = first if cfg.header else [f"f{i}" for i in range(width)]
    if len(set(names)) != width:
        raise ValueError("column names must be unique")
    if cfg.header:
        lines = _lines(spark, path, header=True)
    keep = roles(width, cfg.label_column, cfg.weight_column, cfg.ignored_columns)
    cells = F.transform(F.split("value", ","), _trim)
    bad = (F.size("c") != width) | F.exists("c", lambda x: ~F.lower(x).rlike(NUMBER))
    checked = lines.select("value", cells.alias("c")).withColumn("c", F.when(bad, F.raise_error(F.concat(F.lit("malformed row: "), "value"))).otherwise(F.col("c")))
    cell = lambda i: F.col("c")[i].cast("float")
    role = [cell(cfg.label_column).alias("label"), *([cell(cfg.weight_column).alias("weight")] if cfg.weight_column >= 0 else [])]
    return checked.select(*role, *[cell(i).alias(names[i]) for i in keep])


def read_libsvm(spark: SparkSession, path: str, n_features: int = 0) -> DataFrame:
    """label and f0 to f<n-1>; absent entries are 0 and the width is the largest index, or ``n_features`` if that is larger.

    Blank lines and lines that begin with # are skipped; a label that is no number, or has
    a plus sign, is 0; entries without a colon and index 0 raise an error.
    """
    lines = spark.read.text(path).select(_trim(F.col("value")).alias("value")).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", r"\s+").alias("p"), "value")
    entry = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    bad = F.exists(entry, lambda x: ~x.rlike(r"^[0-9]+:[^:]+$") | x.rlike("^0+:"))
    parts = parts.withColumn("e", F.when(bad, F.raise_error(F.concat(F.lit("malformed row: "), "value"))).otherwise(entry))
    index = lambda x: F.split(x, ":")[0].cast("int")
    widest = parts.select(F.max(F.array_max(F.transform("e", index)))).first()[0] or 0
    width = max(widest, n_features)
    label = F.when(F.col("p")[0].rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), F.col("p")[0].cast("float")).otherwise(F.lit(0.0).cast("float"))
    found = F.map_from_entries(F.transform("e", lambda x: F.struct(index(x), F.split(x, ":")[1].cast("float"))))
    rows = parts.select(label.alias("label"), found.alias("m"))
    return rows.select("label", *[F.coalesce(F.element_at("m", i + 1), F.lit(0.0)).cast("float").alias(f"f{i}") for i in range(width)])


def read_input(spark: SparkSession, path: str, config: Data | None = None) -> DataFrame:
    """By format: everything but ``libsvm`` is CSV."""
    cfg = config or Data()
    return read_libsvm(spark, path, cfg.n_features) if cfg.format == "libsvm" else read_csv(spark, path, cfg)


def write_predictions(df: DataFrame, path: str, column: str = "prediction") -> None:
    df.select(column).write.csv(path, header=True)
