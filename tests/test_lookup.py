"""As-of joins, orders by chance, look-up by number and the table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplebed.functions import table_functions
from ripplebed.operators import asof, layout, sinks


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_asof(spark, parts):
    rng = np.random.default_rng(parts)
    group = lambda: None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else str(rng.integers(0, 5))
    place = lambda: None if rng.random() < 0.05 else int(rng.integers(0, 40))
    left = [(group(), place(), i) for i in range(300)]
    right = [(group(), place(), i) for i in range(80)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        one = spark.createDataFrame(left, "g string, t long, i long")
        two = spark.createDataFrame(right, "g string, at long, k long")
        got = {r["i"]: (r["at"], r["k"]) for r in asof.asof(one, two, ["g"], "t", "at").collect()}
        no_group = {r["i"]: r["k"] for r in asof.asof(one, two.select("at", "k"), [], "t", "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 300
    for g, t, i in left:
        fits = [(at, k) for h, at, k in right if h == g and at is not None and t is not None and at <= t]
        assert got[i] == max(fits, default=(None, None))
        assert no_group[i] == max(((at, k) for _, at, k in right if at is not None and t is not None and at <= t), default=(None, None))[1]


def test_asof_of_nothing(spark):
    none = spark.createDataFrame([], "g string, at long, k long")
    some = spark.createDataFrame([("a", 1), (None, None)], "g string, t long")
    assert [r["k"] for r in asof.asof(some, none, ["g"], "t", "at").collect()] == [None, None]
    assert asof.asof(none.select("g", F.col("at").alias("t")), none, ["g"], "t", "at").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1009, 50_000])
def test_permutation(spark, n):
    orders = []
    for seed in (0, 1):
        got = [r["p"] for r in spark.range(n).select("id", layout.permuted(F.col("id"), n, seed).alias("p")).orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        orders.append(got)
    if n > 100:
        assert orders[0] != orders[1]
        x, y = np.arange(n), np.array(orders[0])
        assert abs(np.corrcoef(x, y)[0, 1]) < 0.15 and abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.15


def test_dataset_opens_what_is_asked_for(spark, tmp_path):
    rows = spark.range(2000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 10)).alias("path"), F.concat(F.lit("s"), F.floor(F.col("id") / 10)).alias("stem"), (F.col("id") % 10).alias("start_sample"),
        F.array(F.array(F.col("id").cast("float"))).alias("data"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("drop_reason"))
    sinks.append(rows, rows.select("path", "stem"), str(tmp_path / "runs"), "one")
    sinks.compact(spark, str(tmp_path / "runs"), str(tmp_path / "packed"), 40e-6, ["start_sample"])
    ds = sinks.WindowDataset(spark, str(tmp_path / "packed"))
    assert len(ds) == 2000 and len(ds.names) == 200
    numbers = [1999, 0, 1000, 1001]
    got = ds.take(numbers)
    assert [r["global_idx"] for r in got] == numbers and len({r["out_name"] for r in got}) == len(ds.files_of(numbers)) == 3
    scan = ds._asked(numbers)._jdf.queryExecution().toString()
    assert "PartitionFilters: [out_name" in scan and "PushedFilters: [In(global_idx" in scan
    assert ds.take([]) == []
    with pytest.raises(IndexError):
        ds.take([2000])
    places = ds.epoch(1).select("place", "global_idx").collect()
    assert sorted(r["place"] for r in places) == list(range(2000)) and sum(r["place"] == r["global_idx"] for r in places) < 20


def test_table_function(spark):
    table_functions.register(spark)
    df = spark.createDataFrame([("a" if i % 3 else "b", 100 - i, float(i)) for i in range(20)], "g string, t int, v double")
    got = {(r["g"], r["win_idx"]): r["values"] for r in spark.sql("SELECT * FROM fixed_windows(TABLE({df}), by => 'g', order => 't', value => 'v', width => 3)", df=df).collect()}
    want = {}
    for g in "ab":
        v = [float(i) for i in range(19, -1, -1) if ("a" if i % 3 else "b") == g]
        want |= {(g, k): v[3 * k : 3 * k + 3] for k in range(len(v) // 3)}
    assert got == want
    with pytest.raises(Exception, match="no such columns"):
        spark.sql("SELECT * FROM fixed_windows(TABLE({df}), by => 'g', order => 'x', value => 'v', width => 3)", df=df).collect()
