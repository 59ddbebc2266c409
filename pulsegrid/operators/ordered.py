"""Ordered work per key that survives a key holding a large share of all rows.

Spark runs one window partition in one task, so a plain `PARTITION BY owner` puts a whole owner on one
core. `Ordered` measures the largest key first. While every key fits in a block, plain window functions
are used and nothing else happens. Otherwise each key's rows are cut into blocks of exactly
`block_rows` consecutive rows; windows run per block, rows next to a block edge are lent to the
neighbouring block, and running values are carried over from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.session import checkpointed

BLOCK_ROWS = 4_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest key: a partial count per key, then one number."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def sized(df: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS, growth: int = 8, **given) -> dict:
    """Measure the largest key once for a chain of steps whose keys grow at most `growth` times.

    Returns the arguments for `Ordered`, so that later steps do not run the chain again to measure it.
    """
    if "bounded" in given:
        return {"block_rows": block_rows, **given}
    return {"block_rows": block_rows, "bounded": largest_group(df, keys) * growth <= block_rows}


def sized_together(parts: list[DataFrame], keys: list[str], block_rows: int = BLOCK_ROWS, growth: int = 8, **given) -> dict:
    """As `sized` for rows that are merged: a key holds at most its largest groups of all parts together."""
    if "bounded" in given:
        return {"block_rows": block_rows, **given}
    return {"block_rows": block_rows, "bounded": sum(largest_group(p, keys) for p in parts) * growth <= block_rows}


class Ordered:
    """Rows of `df` in the order `order` (column names, unique within a key) for every key."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], *,
                 block_rows: int = BLOCK_ROWS, bounded: bool | None = None):
        """`bounded=True`: no key exceeds a block; `False`: some may; `None`: measure."""
        self.keys, self.order, self.block_rows = list(keys), list(order), block_rows
        self.blocked = largest_group(df, self.keys) > block_rows if bounded is None else not bounded
        self.df = self._cut(df) if self.blocked else df

    # -- plumbing ---------------------------------------------------------------------------------

    def _cut(self, df: DataFrame) -> DataFrame:
        parts = max(2, -(-df.count() // self.block_rows))
        placed = checkpointed(
            df.repartitionByRange(parts, *self.keys, *self.order)
            .withColumn("_part", F.spark_partition_id()))
        before = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = (placed.groupBy(*self.keys, "_part").agg(F.count("*").alias("_n"))
                  .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
        local = Window.partitionBy(*self.keys, "_part").orderBy(*self.order)
        keys = [*self.keys, "_part"]
        numbered = (placed.withColumn("_local", F.row_number().over(local))
                    .join(_renamed(starts, keys), _same(keys), "left")
                    .drop(*[f"_r_{k}" for k in keys]))
        return (numbered.withColumn("_row_no", F.col("_local") + F.col("_start"))
                .withColumn("_row_block", F.floor((F.col("_row_no") - 1) / F.lit(self.block_rows)))
                .drop("_part", "_local", "_start"))

    def _with(self, df: DataFrame) -> "Ordered":
        other = object.__new__(Ordered)
        other.__dict__.update(self.__dict__)
        other.df = df
        return other

    @property
    def _parts(self) -> list[str]:
        return [*self.keys, "_row_block"] if self.blocked else self.keys

    @property
    def rows(self) -> DataFrame:
        """The rows with the added columns, without helper columns."""
        return self.df.drop("_row_no", "_row_block")

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> "Ordered":
        """Apply a row-wise change (new columns); it must not drop or reorder rows."""
        return self._with(fn(self.df))

    # -- operators --------------------------------------------------------------------------------

    def number(self, name: str) -> "Ordered":
        """Position of the row within its key, from 1."""
        if self.blocked:
            return self._with(self.df.withColumn(name, F.col("_row_no")))
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        return self._with(self.df.withColumn(name, F.row_number().over(w).cast("long")))

    def around(self, before: int, after: int, build: Callable[[WindowSpec], dict[str, Column]]) -> "Ordered":
        """Columns that look at most `before` rows back and `after` rows ahead."""
        if not self.blocked:
            return self._with(self.df.withColumns(build(Window.partitionBy(*self.keys).orderBy(*self.order))))
        if max(before, after) > self.block_rows:
            raise ValueError("frame is longer than a block")
        pos = (F.col("_row_no") - 1) % F.lit(self.block_rows)
        homes = F.filter(
            F.array(
                F.col("_row_block"),
                F.when(pos < after, F.col("_row_block") - 1),
                F.when(pos >= self.block_rows - before, F.col("_row_block") + 1)),
            lambda b: b.isNotNull() & (b >= 0))
        lent = self.df.withColumn("_home", F.explode(homes))
        w = Window.partitionBy(*self.keys, "_home").orderBy(*self.order)
        return self._with(lent.withColumns(build(w)).filter("_home = _row_block").drop("_home"))

    def running(self, columns: dict[str, tuple[str, Column]], *, reverse: bool = False,
                current: bool = True) -> "Ordered":
        """Running values from the first row of the key (from the last one if `reverse`).

        `columns` maps a new name to `(kind, value)` with kind sum, min, max or last (ignores NULL).
        `current=False` leaves the row itself out.
        """
        order = [F.desc(c) for c in self.order] if reverse else [F.asc(c) for c in self.order]
        end = Window.currentRow if current else -1
        w = Window.partitionBy(*self._parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        values = self.df.withColumns({f"_v_{n}": v for n, (_, v) in columns.items()})
        local = values.withColumns({n: _window_agg(k, F.col(f"_v_{n}"), w) for n, (k, _) in columns.items()})
        if not self.blocked:
            return self._with(local.drop(*[f"_v_{n}" for n in columns]))
        rank = -F.col("_row_no") if reverse else F.col("_row_no")
        per_block = values.groupBy(*self._parts).agg(*[
            _block_agg(k, F.col(f"_v_{n}"), rank).alias(f"_b_{n}") for n, (k, _) in columns.items()])
        step = F.desc("_row_block") if reverse else F.asc("_row_block")
        wb = Window.partitionBy(*self.keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(*self._parts, *[
            _window_agg(k, F.col(f"_b_{n}"), wb).alias(f"_c_{n}") for n, (k, _) in columns.items()])
        joined = local.join(_renamed(carried, self._parts), _same(self._parts), "left")
        out = joined.withColumns({n: _merge(k, F.col(n), F.col(f"_c_{n}")) for n, (k, _) in columns.items()})
        return self._with(out.drop(*[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns],
                                   *[f"_r_{k}" for k in self._parts]))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_r_{k}" for k in keys})


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return cond


def _window_agg(kind: str, value: Column, w: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(w)


def _block_agg(kind: str, value: Column, rank: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), rank))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _merge(kind: str, local: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "sum":
        return F.when(local.isNull(), carried).otherwise(local + F.coalesce(carried, F.lit(0)))
    return (F.least if kind == "min" else F.greatest)(local, carried)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]], *,
                      block_rows: int = BLOCK_ROWS, bounded: bool | None = None) -> DataFrame:
    """Exact order statistics per key; NULL values are ignored.

    `wanted` maps an output name to `(kind, p)`:
    linear - interpolated quantile at p (p = 0.5 is the median);
    upper  - element floor(n * p) of the sorted values, from 0;
    lower  - element floor(p * (n - 1)).
    Equal values are counted first, so a key's rows never meet in one task; the positions then come
    from a running count over distinct values.
    """
    if bounded is None and largest_group(df, keys) <= block_rows:
        bounded = True  # distinct values cannot outnumber rows
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    seen = Ordered(counts, keys, [value], block_rows=block_rows, bounded=bounded).running(
        {"_upto": ("sum", F.col("_n"))}).rows
    total = df.groupBy(*keys).agg(F.count(value).alias("_total"))
    placed = seen.join(_renamed(total, keys), _same(keys)).drop(*[f"_r_{k}" for k in keys])
    n = F.col("_total").cast("double")

    def element(index: Column) -> Column:
        inside = (index < F.col("_upto")) & (index >= F.col("_upto") - F.col("_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for name, (kind, p) in wanted.items():
        if kind == "linear":
            at = (n - 1) * F.lit(p)
            lo = F.floor(at)
            aggs += [element(lo).alias(f"{name}_lo"),
                     element(F.least(lo + 1, n - 1)).alias(f"{name}_hi"), F.max(at - lo).alias(f"{name}_w")]
        elif kind == "upper":
            aggs.append(element(F.least(F.floor(n * F.lit(p)), n - 1)).alias(name))
        elif kind == "lower":
            aggs.append(element(F.floor((n - 1) * F.lit(p))).alias(name))
        else:
            raise ValueError(kind)
    found = placed.groupBy(*keys).agg(*aggs) if keys else placed.agg(*aggs)
    outputs = [
        (F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * F.col(f"{name}_w")).alias(name)
        if kind == "linear" else F.col(name)
        for name, (kind, _) in wanted.items()]
    return found.select(*keys, *outputs)
