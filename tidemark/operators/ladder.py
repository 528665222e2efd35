"""First print that meets a position's condition, on a ladder of buckets over the print's rank.

Prints are numbered per key from the end (the last is -1, see ``with_ranks``), and buckets hold 8, 64, 512, ... consecutive ranks. So a bucket
never holds more prints than its level says, however many fall into one second, and a position that looks from its entry to the end of the tape
meets at most seven buckets a level. A bucket carries bounds of its prints (maxima and minima). The first bucket whose bounds allow a hit
is opened, one level at a time, down to single prints, where the condition itself is asked. Rows read for a position grow with the
number of levels, the logarithm of its key's prints. Bounds may be too hopeful: a bucket that turns out to hold no hit is passed
over and the search goes on behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket
from tidemark.operators.slicing import multiplied, running, width_or_layout
from tidemark.session import cut_lineage

BITS = 3  # eight children a bucket
RANK = "rk"


def with_ranks(prints: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts", "blk", "li"), ahead: dict[str, tuple[str, Column]] | None = None,
               slice_width: int | None = None) -> DataFrame:
    """Adds ``rk``: -1 for a key's last print, -2 for the one before, and so on, in one pass from the end.

    ``ahead`` are further aggregates over the prints after each one (kinds as in ``slicing.running``).
    """
    back = prints.select("*", *[(-F.col(c)).alias(f"_n{c}") for c in order])
    got = running(back, by, [f"_n{c}" for c in order], {"_after": ("count", F.lit(1)), **(ahead or {})},
                  bucket(f"_n{order[0]}", width_or_layout(slice_width)), False)
    return got.withColumn(RANK, (-1 - F.col("_after")).cast("long")).drop("_after", *[f"_n{c}" for c in order])


class Ladder:
    """The prints and the bounds of their buckets, written once.

    ``most`` and ``least`` map names to columns of the prints; a bucket has the largest (smallest) value of its prints under that name.
    """

    def __init__(self, prints: DataFrame, by: Sequence[str], most: dict[str, Column], least: dict[str, Column], columns: Sequence[str]):
        self.by, self.most, self.least = list(by), list(most), list(least)
        base = prints.select(*self.by, RANK, *[c.cast("double").alias(n) for n, c in {**most, **least}.items()], *[c for c in columns if c != RANK])
        self.table = cut_lineage(base)
        top = self.table.agg(F.max(-F.col(RANK)).alias("n")).first()["n"] or 0
        self.levels = 0
        while top > 1 << (BITS * (self.levels + 1)):
            self.levels += 1
        bounds = [F.max(n).alias(n) for n in self.most] + [F.min(n).alias(n) for n in self.least]
        steps, below = [], self.table.withColumn("_b", F.col(RANK))
        for level in range(1, self.levels + 1):
            below = below.groupBy(*self.by, F.shiftright("_b", BITS).alias("_b")).agg(*bounds)
            below = cut_lineage(below) if level < self.levels else below
            steps.append(below.withColumn("_lv", F.lit(level)))
        # single prints are asked for the condition itself, so they need no bounds
        all_ = self.table.select(*self.by, F.col(RANK).alias("_b"), *[c for c in columns if c != RANK]).withColumn("_lv", F.lit(0))
        for s in steps:
            all_ = all_.unionByName(s, allowMissingColumns=True)
        self.all = cut_lineage(all_) if steps else all_

    def _units(self, lo: Column) -> Column:
        """Array of (lv, b) that cover the ranks lo .. -1: at each level the buckets up to the next bucket of the level above."""
        at = lambda level: (lambda b: F.struct(F.lit(level).alias("lv"), b.alias("b")))
        parts, a = [], lo
        for level in range(self.levels + 1):
            up = -F.shiftright(-a, BITS)  # first whole bucket of the next level
            last = (F.lit(0) if level == self.levels else F.shiftleft(up, BITS)) - 1
            parts.append(F.when(a <= last, F.transform(F.sequence(a, last), at(level))).otherwise(
                F.array().cast("array<struct<lv:int,b:bigint>>")))
            a = up
        return F.when(lo < 0, F.concat(*parts))

    def _alive(self, rows: DataFrame, units: Column, otherwise: Column | None, may: Callable[[], Column], hit: Callable[[], Column], columns: list[str],
               asks: str | None = None) -> DataFrame:
        """``rows`` with ``_u``, the first of their ``units`` that may hold a hit (at level 0: is one), else ``otherwise``; without that such rows drop out.
        ``asks``: an array of structs, a row for each once its units have met the ladder."""
        keep = [c for c in rows.columns if c != "_u"]
        each = rows.select(*keep, *([] if otherwise is None else [otherwise.alias("_o")]), F.explode(
            units if otherwise is None else F.concat(units, F.array(F.struct(F.lit(-1).alias("lv"), F.lit(0).cast("long").alias("b"))))).alias("_w"))
        each = each.withColumn("_lv", F.col("_w.lv")).withColumn("_b", F.col("_w.b"))
        got = multiplied(each).join(self.all, [*self.by, "_lv", "_b"], "inner" if otherwise is None else "left")
        if asks:
            fields = rows.schema[asks].dataType.elementType.names
            got = got.withColumn("_ask", F.explode(asks)).select("*", "_ask.*").drop("_ask", asks)
            keep = [c for c in keep if c != asks] + fields
        ok = F.when(F.col("_lv") == 0, hit()).when(F.col("_lv") > 0, may())
        got = got.filter(ok if otherwise is None else F.coalesce(ok, F.col("_lv") == -1))
        start = F.col("_b") * F.element_at(F.array(*[F.lit(1 << (BITS * v)) for v in range(self.levels + 1)]), F.greatest(F.col("_lv"), F.lit(0)) + 1)
        unit = F.struct(start.cast("long").alias("at"), F.col("_lv").alias("lv"), F.col("_b").alias("b"), F.struct(*columns).alias("p"))
        return got.groupBy(*keep).agg(F.min(unit if otherwise is None else F.when(F.col("_lv") == -1, F.col("_o")).otherwise(unit)).alias("_u"))

    def first(self, pos: DataFrame, row_id: Sequence[str], may: Callable[[], Column], hit: Callable[[], Column], columns: Sequence[str],
              lo: str = "lo", name: str = "hit", asks: str | None = None) -> DataFrame:
        """``row_id`` with ``name``: struct ``columns`` of the first print of rank ``lo`` or more for which ``hit()`` holds; rows without one are absent.

        ``pos`` holds the key, ``row_id`` (unique), ``lo`` and what the conditions ask for; ``asks`` names an array of structs of it, searches that share
        all else: the result has a row for each that finds one, with the struct's fields that ``row_id`` names. ``hit()`` and ``may()`` are over columns of ``pos`` and of the
        ladder; ``may()`` must be true of a bucket's bounds whenever ``hit()`` is true of one of its prints.
        """
        rid, columns = list(row_id), list(columns)
        todo, done = pos.withColumn("_lo", F.col(lo).cast("long")), None
        size = F.element_at(F.array(*[F.lit(1 << (BITS * v)) for v in range(self.levels + 1)]), F.col("_u.lv") + 1).cast("long")
        none = F.lit(None).cast(self.all.select(F.struct(*columns).alias("p")).schema["p"].dataType)
        while True:
            got = self._alive(todo, self._units(F.col("_lo")), None, may, hit, columns, asks if done is None else None)
            for _ in range(self.levels):
                # an open bucket gives its children, or the rank behind it (level -1) if none of them is alive; found prints stay
                deep = F.col("_u.lv") > 0
                children = F.when(deep, F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda i: F.struct(
                    (F.col("_u.lv") - 1).alias("lv"), (F.shiftleft(F.col("_u.b"), BITS) + i).alias("b")))).otherwise(F.array().cast("array<struct<lv:int,b:bigint>>"))
                past = F.struct((F.col("_u.at") + size).alias("at"), F.lit(-1).alias("lv"), F.col("_u.b").alias("b"), none.alias("p"))
                got = self._alive(got, children, F.when(deep, past).otherwise(F.col("_u")), may, hit, columns)
            got = cut_lineage(got) if self.levels else got
            hits = got.filter("_u.lv = 0").select(*rid, F.col("_u.p").alias(name))
            done = hits if done is None else done.unionByName(hits)
            missed = got.filter("_u.lv = -1 and _u.at < 0").withColumn("_lo", F.col("_u.at")).drop("_u") if self.levels else None
            if missed is None or missed.isEmpty():
                return done
            todo = missed
