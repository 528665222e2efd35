"""Helpers shared by the training-data operators: tables, words, folds, query registry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(column, rows: int = 256):
    """The Python values of an Arrow column, made a few rows at a time, so that a task never holds those of a whole batch."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as the empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's document columns: with doc_id it tells rows apart unless they are the same in every column."""
    return F.xxhash64(*[F.col(c) for c in df.columns if c in DOCUMENT])


def make_room(docs: DataFrame, results: Iterable[str]) -> DataFrame:
    """``docs`` with columns named like a result renamed: they get the suffix ``_in``, as often as it takes to clash with nothing."""
    taken, new = {*docs.columns, *results}, {}
    for c in results:
        if c in docs.columns:
            to = f"{c}_in"
            while to in taken:
                to += "_in"
            taken.add(to)
            new[c] = to
    return docs.withColumnsRenamed(new)


def shielded(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` with the columns of ``docs``: those that are not document columns go through it under names that clash with none."""
    away = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    back = {v: k for k, v in away.items()}
    out = stage(docs.withColumnsRenamed(away))
    return out.select([F.col(away.get(c, c)) for c in docs.columns]).withColumnsRenamed(back)
