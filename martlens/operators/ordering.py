"""Ranks, tiles, running totals and medians over a whole frame.

A window without PARTITION BY moves every row to one task. Here the frame is
range-sorted across tasks and written once with each row's part and place in
it. Only one summary row per part then passes through a single task, and their
number is bounded by the shuffle partitions, not by the data.

Where only some ranks are wanted, as for tiles and medians, a sketch tells between
which values they lie, and the rows between those alone are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.session import written

PART = "_part"
PLACE = "_place"
ACCURACY, MARGIN = 10_000, 0.002  # of sketches; share of the rows around a rank
_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above these


def range_sorted(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Written copy of ``df`` with its part number and 1-based place in the part.

    End ``keys`` with a unique column: it makes the order total and lets equal
    leading values spread over several parts.
    """
    row = F.monotonically_increasing_id()
    marked = df.orderBy(*keys).withColumn(PLACE, row)
    mask = F.lit((1 << _PLACE_BITS) - 1)
    return written(
        marked.withColumn(PART, F.shiftright(PLACE, _PLACE_BITS)).withColumn(
            PLACE, F.col(PLACE).bitwiseAND(mask) + 1
        )
    )


def _before(column: str) -> Column:
    """Sum of ``column`` over the earlier parts."""
    window = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def global_position(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Adds ``position`` (1-based rank of the row) and ``total`` (rows in all)."""
    rows = range_sorted(df, keys)
    parts = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_rows"))
    parts = parts.select(
        PART,
        _before("_rows").alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias("total"),
    )
    return (
        rows.join(F.broadcast(parts), PART)
        .withColumn("position", F.col("_offset") + F.col(PLACE))
        .drop(PART, PLACE, "_offset")
    )


def position_in_group(
    df: DataFrame, group: str, keys: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """Adds the 1-based rank of the row within its group; groups are few.

    One range sort ranks all groups together. What is broadcast has a row for each
    group and part at most.
    """
    rows = range_sorted(df, [group, *keys])
    parts = rows.groupBy(group, PART).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first")
    )
    earlier = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    parts = parts.select(group, PART, offset.alias("_offset"))
    return (
        rows.join(F.broadcast(parts), [group, PART])
        .withColumn(name, F.col(PLACE) + F.col("_offset"))
        .drop(PART, PLACE, "_offset")
    )


def _bracket(value: str, share: Column | float) -> Column:
    """Values surely around the rank at ``share`` of the rows, by a sketch.

    The sketch is off by a share of 1 / ACCURACY of the rows at most, and the two
    values are asked for well outside of that.
    """
    around = [F.greatest(F.lit(0.0), F.lit(share) - MARGIN), F.least(F.lit(1.0), F.lit(share) + MARGIN)]
    return F.percentile_approx(value, F.array(*around), ACCURACY)


def distributed_ntile(
    df: DataFrame, tiles: int, keys: Sequence[str], name: str
) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY keys)``: sizes differ by one, larger first.

    Only the last row of each tile has to be found. A sketch of the first key, a
    number, brackets it; the rows in the brackets alone are sorted, and every row is
    then compared with the last rows of all tiles. The other keys make the order
    total. Rows whose first key is null come first, and if there are any, or where a
    row that should be in a bracket is not, all rows are sorted.
    """
    if tiles == 1:
        return df.withColumn(name, F.lit(1))
    rows = written(df)
    value = keys[0]
    n = rows.count()
    small, larger = divmod(n, tiles)
    ends = {k: k * small + min(k, larger) for k in range(1, tiles)}
    cuts = None
    if n:
        around = [_bracket(value, end / n).alias(f"around_{k}") for k, end in ends.items()]
        found = rows.agg(F.count(value).alias("known"), *around).first()
        if found.known == n:
            cuts = _rows_at(rows, keys, {k: (end, *found[f"around_{k}"]) for k, end in ends.items()})
    if cuts is None:
        return _sorted_ntile(rows, tiles, keys, name)
    kinds = [rows.schema[key].dataType for key in keys]
    beyond = [
        F.struct(*[F.col(key) for key in keys])
        > F.struct(*[F.lit(part).cast(kind).alias(key) for key, part, kind in zip(keys, cut, kinds)])
        for cut in cuts
    ]
    tile = sum((b.cast("int") for b in beyond), F.lit(1))
    return rows.withColumn(name, tile.cast("int"))


def _rows_at(
    rows: DataFrame, keys: Sequence[str], wanted: dict[int, tuple]
) -> list[tuple] | None:
    """Keys of the rows at some positions, each between two values of the first key."""
    value = F.col(keys[0])
    inside = {k: value.between(low, high) for k, (_, low, high) in wanted.items()}
    counts = rows.agg(
        *[F.count_if(value < low).alias(f"below_{k}") for k, (_, low, _) in wanted.items()],
        *[F.count_if(value <= high).alias(f"upto_{k}") for k, (_, _, high) in wanted.items()],
    ).first()
    places = {k: end - counts[f"below_{k}"] for k, (end, _, _) in wanted.items()}
    if any(place < 1 or end > counts[f"upto_{k}"] for (k, place), (end, _, _) in zip(places.items(), wanted.values())):
        return None
    groups = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in inside.items()]))
    near = rows.select(*keys, F.explode(groups).alias("_cut"))
    at = F.lit(False)
    for k, place in places.items():
        at = at | ((F.col("_cut") == k) & (F.col("_position") == place))
    ranked = position_in_group(near, "_cut", keys, "_position").where(at).orderBy("_cut")
    return [tuple(row) for row in ranked.select(*keys).collect()]


def _sorted_ntile(
    df: DataFrame, tiles: int, keys: Sequence[str | Column], name: str
) -> DataFrame:
    sized = global_position(df, keys).withColumns(
        {"_small": F.expr(f"total div {tiles}"), "_larger": F.expr(f"total % {tiles}")}
    )
    in_larger = F.expr("(position - 1) div (_small + 1) + 1")
    beyond = F.expr(
        "_larger + (position - 1 - _larger * (_small + 1)) div greatest(_small, 1) + 1"
    )
    tile = F.when(F.col("position") <= F.expr("_larger * (_small + 1)"), in_larger)
    return sized.withColumn(name, tile.otherwise(beyond).cast("int")).drop(
        "position", "total", "_small", "_larger"
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str | Column],
    values: Sequence[str],
    following: Sequence[str] = (),
) -> DataFrame:
    """Adds ``<value>_upto``: the sum over all rows up to and including this one.

    For columns in ``following`` it also adds ``next_<column>``, the value in the
    next row. The frame must be grouped on the keys already, so that no value
    repeats often enough to fill a part.
    """
    rows = range_sorted(df, keys)
    parts = rows.groupBy(PART).agg(
        *[F.sum(v).alias(f"_{v}_sum") for v in values],
        *[F.min_by(c, PLACE).alias(f"_{c}_first") for c in following],
    )
    next_part = Window.orderBy(PART)
    parts = parts.select(
        PART,
        *[_before(f"_{v}_sum").alias(f"_{v}_before") for v in values],
        *[F.lead(f"_{c}_first").over(next_part).alias(f"_{c}_after") for c in following],
    )
    inside = Window.partitionBy(PART).orderBy(PLACE)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    added = {f"{v}_upto": F.col(f"_{v}_before") + F.sum(v).over(upto) for v in values}
    for c in following:
        added[f"next_{c}"] = F.coalesce(F.lead(c).over(inside), F.col(f"_{c}_after"))
    helpers = [c for c in parts.columns if c != PART]
    return (
        rows.join(F.broadcast(parts), PART).withColumns(added).drop(PART, PLACE, *helpers)
    )


def exact_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Interpolated median of ``value`` per ``group``, nulls left out.

    A sketch brackets the middle of each group, and only values in the brackets are
    sorted. Equal values are counted first, so a value shared by a third of the rows
    is a single row by the time the sort runs. The groups are few, such as the
    metrics of a report: their brackets are broadcast, and the sort key starts with
    the group, so large groups still spread over many parts.
    """
    rows = written(df.select(group, value).where(F.col(value).isNotNull()))
    around = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("_size"), _bracket(value, 0.5).alias("_around")
    )
    marked = rows.join(F.broadcast(around), group)
    low, high = F.col("_around")[0], F.col("_around")[1]
    below = marked.groupBy(group).agg(
        F.first("_size").alias("_size"), F.count_if(F.col(value) < low).alias("_below")
    )
    counted = (
        marked.where(F.col(value).between(low, high))
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counted, [group, value], ["n"])
    bases = ranked.groupBy(group).agg(F.min(F.col("n_upto") - F.col("n")).alias("_base"))
    last = F.col("n_upto") - F.col("_base") + F.col("_below")
    first = last - F.col("n") + 1
    lower = F.expr("(_size + 1) div 2")
    upper = F.expr("_size div 2 + 1")
    covers_lower = (first <= lower) & (lower <= last)
    covers_upper = (first <= upper) & (upper <= last)
    return (
        ranked.join(F.broadcast(bases.join(below, group)), group)
        .where(covers_lower | covers_upper)
        .groupBy(group)
        .agg(((F.min(value) + F.max(value)) / 2).alias("median"))
    )
