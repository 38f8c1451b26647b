"""Places and average ranks over ranges, against plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from kindred.operators import ranks as R


def average(values):
    values = np.array(values)
    return {v: float((values < v).sum() + ((values == v).sum() + 1) / 2) for v in set(values.tolist())}


def test_places_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, v long").repartition(7)
    found = {r["id"]: r["place"] for r in R.placed(frame, F.desc("v"), "id").collect()}
    assert found == {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_places_of_an_empty_frame(spark):
    assert R.placed(spark.createDataFrame([], "id long"), "id").collect() == []


def test_average_ranks_by_group(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.5, rng.random()])) for g in "abc" for _ in range(700)]
    found = R.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()
    wanted = {(g, v): r for g in "abc" for v, r in average([x for k, x in rows if k == g]).items()}
    assert {(r["g"], r["v"]): r["rank"] for r in found} == wanted


def test_a_value_that_most_rows_share_is_one_row(spark):
    rows = [("a", 1.0)] * 5000 + [("a", float(i)) for i in range(2, 50)]
    found = {r["v"]: r["rank"] for r in R.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert found[1.0] == 2500.5 and found[2.0] == 5001.0


def test_no_window_meets_a_whole_group(spark):
    """Every window is over a range, or over one row for each range."""
    frame = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = R.average_ranks(frame, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "_range" in plan
