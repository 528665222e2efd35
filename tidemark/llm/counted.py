"""Joins of rows with a table that knows how many rows each of its keys has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one row in ``PARTS``; by arithmetic there are fewer than ``PARTS`` hot keys, however large the tables are.
PARTS = 1024


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``counted``, one row a key, whose column ``n`` is the number of ``rows`` of that key.

    Rows of hot keys are not shuffled: fewer than ``PARTS`` hot keys are sent to all tasks. The other keys hold at most one row in ``PARTS``
    each and are joined by whatever Spark picks for the sizes. ``counted`` should be a written table, as it is read three times. Keys are not null.
    """
    total = counted.agg(F.sum(n).alias("n")).first()["n"] or 0
    hot = counted.filter(F.col(n) * PARTS > total)
    cold = counted.filter(F.col(n) * PARTS <= total)
    if total < PARTS or hot.isEmpty():
        return rows.join(counted, key, how)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
