"""Ordered scans that do not need a whole group in one task.

A window over ``partitionBy(key)`` puts every row of a key into one task, which
fails when one key holds a large share of the table. The functions here split an
ordered group into consecutive blocks: totals per block are pre-aggregated before
the shuffle, windows over blocks carry the running value from block to block, and
a last window works inside one block only. Blocks of blocks keep every window
small: ids are read digit by digit, values are dealt to range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions.scalar import half_even
from wardflow.session import stored

#: The digits of a 64-bit id begin at these bits. Each has at most 2**22 values, so a window over one is bounded whatever the ids are.
ID_DIGITS = {"_high": 42, "_low": 21}
ID_LEVELS = list(ID_DIGITS)


def with_id_digits(df: DataFrame, identifier: str) -> DataFrame:
    """Add the upper digits of a unique integer id; they keep its order."""
    return df.withColumns({name: F.shiftright(F.col(identifier).cast("long"), bits) for name, bits in ID_DIGITS.items()})


def _level_columns(levels: Sequence[str | Sequence[str]]) -> list[list[str]]:
    return [[level] if isinstance(level, str) else list(level) for level in levels]


def carried_totals(rows: DataFrame, keys: Sequence[str], levels: Sequence[str | Sequence[str]], sums: Sequence[str]) -> DataFrame:
    """Totals of all earlier blocks of the same key, for each block.

    ``levels`` are the leading sort columns (one or several to a level), from
    the coarsest level to the finest. A window sees the blocks of one level inside one block
    of the level above; what lies before that one is carried down by a join.
    """
    levels = _level_columns(levels)
    keys, flat = list(keys), [c for level in levels for c in level]
    above = keys + flat[: len(flat) - len(levels[-1])]
    totals = rows.groupBy(*keys, *flat).agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(*above).orderBy(*levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, *flat, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    if len(levels) == 1:
        return carried
    higher = carried_totals(totals, keys, levels[:-1], sums).select(*above, *[F.col(f"_c_{n}").alias(f"_h_{n}") for n in sums])
    return carried.join(higher, above).select(*keys, *flat, *[(F.col(f"_c_{n}") + F.col(f"_h_{n}")).alias(f"_c_{n}") for n in sums])


def prior_totals(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str | Sequence[str]],
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add ``name`` = sum over all earlier rows of the same key, current row excluded.

    ``levels`` are the leading sort columns, see :func:`carried_totals`; ``order`` is the rest.
    """
    block = [*keys, *[c for level in _level_columns(levels) for c in level]]
    staged = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    carried = carried_totals(staged, keys, levels, [f"_v_{n}" for n in sums])
    inside = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    staged = staged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    return staged.join(carried, block).select(*df.columns, *[(F.col(f"_c__v_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def ordered_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    sums: dict[str, Column] | None = None,
    small: bool = False,
) -> DataFrame:
    """One row per distinct (by, value): row count, running totals below, group totals.

    Returns ``by..., value``, ``n, n_before, n_total`` and the same three columns
    for every extra sum. Rows are first reduced to distinct values (partial
    aggregation). The distinct values are dealt to range partitions, as many as
    their size asks for, and written with the number of their partition, so even
    one group with very many distinct values is scanned by several tasks; any cut
    points give the same result. ``small`` skips the partitions, for values from
    a small domain (hours, days, labels).
    """
    by = list(by)
    sums = {"n": F.lit(1), **(sums or {})}
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(v).cast("double" if n != "n" else "long").alias(n) for n, v in sums.items()])
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    if small:
        below = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            *by,
            value,
            *sums,
            *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_before") for n in sums],
            *[F.sum(n).over(group).alias(f"{n}_total") for n in sums],
        )
    cut = stored(counts.repartitionByRange(*by, value).withColumn("_block", F.spark_partition_id()))
    totals = cut.groupBy(*by, "_block").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    across = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select(
        *by, value, "_block", *sums, *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in sums]
    )
    joined = local.join(carried, by + ["_block"])
    return joined.select(
        *by,
        value,
        *sums,
        *[(F.col(f"_c_{n}") + F.col(f"_i_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def average_ranks(df: DataFrame, value: str, rank: str = "rank", weight: Column | None = None, small: bool = False) -> DataFrame:
    """Rank of every distinct value, ties sharing the mean of their positions."""
    return ordered_counts(df, value, sums={"n": F.lit(1) if weight is None else weight}, small=small).select(
        value, "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(rank)
    )


def value_at(position: Column, value: str) -> Column:
    """Aggregate: the value holding 0-based ``position`` in an ``ordered_counts`` frame."""
    inside = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))
    return F.max(F.when(inside, F.col(value)))


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``sorted(values)[int(n * q)]`` for each quantile, per group."""
    picks = [value_at(F.floor(F.col("n_total") * F.lit(q)), value).alias(name) for name, q in quantiles.items()]
    return ordered_counts(df, value, by).groupBy(*by).agg(*picks)


def attach_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put the columns of ``totals`` next to every row; without a group it is one row."""
    if by:
        return df.join(totals, list(by))
    staged = df.withColumn("_one", totals.select(F.struct(*totals.columns)).scalar())
    return staged.select(*df.columns, "_one.*")


def spread_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, interpolated median, nearest-rank p10/p90, min, max (2 decimals)."""
    by, t = list(by), F.col("n_total")
    picked = ordered_counts(df, value, by).groupBy(*by).agg(
        F.max(t).alias("n_values"),
        (F.sum(F.col(value) * F.col("n")) / F.max(t)).alias("mean"),
        ((value_at(F.floor((t - 1) / 2), value) + value_at(F.floor(t / 2), value)) / 2.0).alias("median"),
        value_at(F.floor(t * F.lit(0.1)), value).alias("p10"),
        value_at(F.floor(t * F.lit(0.9)), value).alias("p90"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return picked.select(
        *by, "n_values", *[half_even(c, 2).alias(c) for c in ("mean", "median", "p10", "p90", "min", "max")]
    )


def spearman(df: DataFrame, x: str, y: str, weight: str | None = None, small: bool = False) -> DataFrame:
    """Rank correlation with ties, one row ``rho, n``.

    Rows are reduced to distinct (x, y) pairs first, so a hot value costs one row.
    ``weight`` names a row-count column of an input that is already reduced.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.sum(weight if weight else F.lit(1)).alias("_w")
    )
    rx = average_ranks(pairs, x, "_rx", F.col("_w"), small).drop("n")
    ry = average_ranks(pairs, y, "_ry", F.col("_w"), small).drop("n")
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = (
        pairs.join(rx, x)
        .join(ry, y)
        .agg(
            F.sum("_w").alias("n"),
            (F.sum(w * a * a)).alias("aa"),
            (F.sum(w * b * b)).alias("bb"),
            (F.sum(w * a * b)).alias("ab"),
        )
    )
    mean = (F.col("n") + 1) / 2.0
    cov = F.col("ab") - F.col("n") * mean * mean
    var = (F.col("aa") - F.col("n") * mean * mean) * (F.col("bb") - F.col("n") * mean * mean)
    return sums.select(F.when(var > 0, cov / F.sqrt(var)).alias("rho"), "n")
