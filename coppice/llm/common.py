"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import remove, shared_dir

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in storage that outlives an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: later plans read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that ``written`` has made and nothing has deleted.
_made: list[str] = []


def made() -> int:
    """How many tables there are: what ``release`` takes."""
    return len(_made)


def release(spark: SparkSession, since: int) -> None:
    """Deletes the tables made after ``since``: for callers whose results are written, and no longer read them."""
    for path in _made[since:]:
        remove(spark, path)
    del _made[since:]


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z only, as ``translate`` leaves every other letter alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Array of the words of a text; empty for a text without any."""
    return F.array_remove(F.split(F.regexp_replace(c, r"[\x09-\x0D]", " "), " "), "")


def lower_words(w: Column) -> Column:
    """The words with A-Z in lower case: words of ASCII alone take the faster way."""
    return F.transform(w, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(lower_az(x)))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text, modulo the number of folds; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``size`` bytes of text at most (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)
