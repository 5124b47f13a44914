from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from martlens.operators import ordering
from martlens.operators.ordering import (
    distributed_ntile,
    exact_medians,
    global_position,
    running_totals,
)


def frame(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, v long").repartition(5, "id")


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 12, 1003])
def test_ntile_equals_the_single_task_window(spark, n):
    rng = random.Random(n)
    # A third of the rows share one value.
    df = frame(spark, [7 if i % 3 == 0 else rng.randrange(50) for i in range(n)])
    ours = distributed_ntile(df, 5, ["v", "id"], "tile").select("id", "tile")
    plain = df.select("id", F.ntile(5).over(Window.orderBy("v", "id")).alias("tile"))
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_tiles_with_nulls_and_other_types(spark):
    rows = [(None if i % 7 == 0 else f"{i % 40}.25", f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "v string, id string").withColumn("v", F.col("v").cast("decimal(28,2)"))
    for part in (df, df.where("v is not null"), df.limit(1), df.where("v is null")):
        ours = distributed_ntile(part, 5, ["v", "id"], "tile").select("id", "tile")
        plain = part.select("id", F.ntile(5).over(Window.orderBy("v", "id")).alias("tile"))
        assert sorted(ours.collect()) == sorted(plain.collect())


def test_only_rows_near_the_wanted_ranks_are_sorted(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.randrange(10**9) for _ in range(20_000)]
    df = frame(spark, values)
    plain = df.select("id", F.ntile(5).over(Window.orderBy("v", "id")).alias("tile"))
    sort, sizes = ordering.range_sorted, []

    def counted(rows, keys):
        sizes.append(rows.count())
        return sort(rows, keys)

    monkeypatch.setattr(ordering, "range_sorted", counted)
    ours = distributed_ntile(df, 5, ["v", "id"], "tile").select("id", "tile")
    assert sorted(ours.collect()) == sorted(plain.collect())
    assert exact_medians(df.withColumn("g", F.lit("x")), "g", "v").first()["median"] == statistics.median(values)
    assert len(sizes) == 2 and max(sizes) < 600


def test_ntile_puts_larger_tiles_first_and_breaks_ties_by_id(spark):
    df = frame(spark, [5, 5, 5, 1, 9, 8, 7])
    tiles = {r.id: r.tile for r in distributed_ntile(df, 5, ["v", "id"], "tile").collect()}
    assert tiles == {3: 1, 0: 1, 1: 2, 2: 2, 6: 3, 5: 4, 4: 5}


def test_position_descending(spark):
    df = frame(spark, [4, 2, 9])
    ranked = global_position(df, [F.desc("v"), "id"])
    assert {r.v: (r.position, r.total) for r in ranked.collect()} == {
        9: (1, 3),
        4: (2, 3),
        2: (3, 3),
    }


def test_running_totals_and_next_values_cross_parts(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 500)
    df = frame(spark, values).withColumn("w", F.col("v") % 11)
    rows = running_totals(df, ["v"], ["w"], following=["w"]).orderBy("v").collect()
    total = 0
    ordered = sorted(values)
    for place, row in enumerate(rows):
        total += row.v % 11
        assert row.v == ordered[place]
        assert row.w_upto == total
        following = ordered[place + 1] % 11 if place + 1 < len(ordered) else None
        assert row.next_w == following


def test_medians_per_group(spark):
    rng = random.Random(2)
    groups = {
        "even": [rng.randrange(100) / 4 for _ in range(200)],
        "odd": [rng.randrange(100) / 4 for _ in range(201)],
        "tied": [1.0] * 90 + [3.0] * 90,
        "one": [2.5],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r["median"] for r in exact_medians(df, "g", "v").collect()}
    assert found == {g: statistics.median(values) for g, values in groups.items()}


def test_positions_within_groups(spark):
    rows = [("a", i) for i in range(70)] + [("b", 5)] + [("c", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(6)
    found = ordering.position_in_group(frame, "g", ["v"]).collect()
    assert sorted((r.g, r.v, r.position) for r in found) == sorted(
        (g, v, 1 if g == "b" else v + 1) for g, v in rows
    )
