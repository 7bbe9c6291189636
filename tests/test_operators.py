import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenflow.operators import groups as g
from burdenflow.operators import ordering as o
from burdenflow.operators import shaping as sh
from burdenflow.operators.joins import interval_join, keep_keys, lookup, natural_join

PROBS = {"q025": 0.025, "median": 0.5, "q99": 0.99}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value holds a third of them, and one group has one row."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=4000).round(2)
    hot[: len(hot) // 3] = 0.25
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in rng.normal(size=300)] + [("one", 1.0)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5).cache()


def by_key(df):
    return {r.k: r for r in df.collect()}


def arrays(df):
    pdf = df.toPandas()
    return {k: np.sort(x.v.to_numpy()) for k, x in pdf.groupby("k")}


@pytest.mark.parametrize("small", [o.SMALL, 0])
def test_quantiles_match_numpy(skewed, small, monkeypatch):
    monkeypatch.setattr(o, "SMALL", small)
    monkeypatch.setattr(o, "SLACK", 0.1 if small == 0 else o.SLACK)  # a tiny group's next rank is far away
    got = by_key(o.quantiles(skewed, ["k"], "v", PROBS))
    for k, x in arrays(skewed).items():
        assert got[k].n == len(x)
        assert [got[k][p] for p in PROBS] == pytest.approx(list(np.quantile(x, list(PROBS.values()))), abs=1e-12)


@pytest.mark.parametrize("block", [o.RANK_BLOCK, 40])
def test_hdi_matches_search(skewed, block):
    got = by_key(o.hdi(skewed, ["k"], "v", 0.9, block=block))
    for k, x in arrays(skewed).items():
        width = int(np.floor(len(x) * 0.9))
        if len(x) < 2:
            assert (got[k].lower, got[k].upper) == (None, None)
            continue
        gaps = x[width:] - x[: len(x) - width]
        i = int(np.argmin(gaps))
        assert (got[k].lower, got[k].upper) == (x[i], x[i + width])
        tail = np.quantile(x, [0.05, 0.95], method="inverted_cdf")
        assert got[k].upper - got[k].lower <= tail[1] - tail[0] + 0.02


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, v double")
    row = o.quantiles(df, ["k"], "v", {"median": 0.5}).first()
    assert (row.n, row.median) == (2, 2.0)


def test_numbering_and_sums(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1000).alias("x"))
    rows = o.number_rows(df, ["x"]).collect()
    assert all(r.rn == r.x + 1 for r in rows) and len(rows) == 1000
    sums = o.prefix_sums(df, ["x"], "x", by=["g"]).toPandas().sort_values(["g", "x"])
    want = sums.groupby("g").x.cumsum() - sums.x
    assert (sums.before == want).all()


def test_buckets_follow_the_order(spark):
    values = [0.0, -0.0, 1e-300, -1e-300, 1.0, -1.0, 1e300, -1e300, 3.5, 3.5000001, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = o.with_buckets(df, [], "v").orderBy("v").collect()
    placed = [(r._coarse, r._fine) for r in rows]
    assert placed == sorted(placed)


def test_values_of_one_magnitude_are_split_again(spark):
    df = spark.range(100_000).select((1000 + F.col("id") / 1e6).alias("v"))
    sizes = o.with_buckets(df, [], "v").groupBy("_coarse", "_fine").count()
    by_coarse = sizes.groupBy("_coarse").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()
    assert max(r.n for r in by_coarse) > 40_000 and max(r.most for r in by_coarse) < 1_000
    row = o.quantiles(df, [], "v", {"median": 0.5}).first()
    assert row.median == pytest.approx(1000 + 99_999 / 2e6, abs=1e-12)


def test_quantiles_of_large_groups(spark):
    """Groups whose ranks are bounded by sketches: skewed, with a value that most rows share, of whole numbers."""
    ids = spark.range(0, 300_000, 1, 8).select("id", (F.hash("id") % 1_000_000 / 1e6).alias("u"))
    df = ids.select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 3 == 0, F.exp(20 * F.col("u"))).when(F.col("id") % 3 == 1, F.when(F.col("u") < 0.4, 7.0).otherwise(F.col("u"))).otherwise(F.floor(100 * F.col("u"))).alias("v"))
    got = by_key(o.quantiles(df, ["k"], "v", PROBS))
    for k, x in arrays(df).items():
        assert [got[k][p] for p in PROBS] == pytest.approx(list(np.quantile(x, list(PROBS.values()))), rel=1e-12)


def test_quantiles_of_values_without_order(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", nan), ("a", 1.0), ("a", 2.0), ("b", nan), ("c", -inf), ("c", 0.0), ("c", -0.0), ("c", inf), (None, 5.0)], "k string, v double")
    got = by_key(o.quantiles(df, ["k"], "v", {"low": 0.0, "median": 0.5, "high": 1.0}))
    assert (got["a"].low, got["a"].median, got["c"].low, got["c"].high, got[None].median) == (1.0, 2.0, -inf, inf, 5.0)
    assert np.isnan(got["a"].high) and np.isnan(got["b"].median)


def test_constant_keys_stay_out_of_joins(spark):
    df = spark.range(5000).select(F.lit("x").alias("label"), F.col("id").cast("double").alias("v"))
    found = o.quantiles(df, ["label"], "v", {"median": 0.5})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tuple(found.first()) == ("x", 5000, 2499.5)
    assert o.quantiles(df.where("v < 0"), [], "v", {"median": 0.5}).count() == 0


def test_samples_repeat_and_count(spark):
    df = spark.range(5000)
    first = {r.id for r in o.sample_rows(df, ["id"], 300).collect()}
    again = {r.id for r in o.sample_rows(df.repartition(7), ["id"], 300).collect()}
    assert len(first) == 300 and first == again
    assert o.sample_rows(df, ["id"], 9000).count() == 5000


def test_natural_join_matches_missing_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("d", 40)], "k string, y int")
    got = {tuple(r) for r in natural_join(left, right).collect()}
    assert got == {("a", 1, 10), (None, 2, 20), ("c", 3, None)}
    full = {tuple(r) for r in natural_join(left, right, "full").collect()}
    assert full == got | {("d", None, 40)}
    with pytest.raises(ValueError):
        natural_join(left, right.select("y"))
    with pytest.raises(ValueError):
        natural_join(left, right.withColumn("x", F.lit(1)), on=["k"])


def test_lookup_and_keep_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "a int, b string")
    dim = spark.createDataFrame([(1, "one")], "rn int, name string")
    assert {tuple(r) for r in lookup(left, dim, {"a": "rn"}).collect()} == {(1, "x", "one"), (2, "y", None), (None, "z", None)}
    assert [r.a for r in keep_keys(left, dim.select(F.col("rn").alias("a")), ["a"]).collect()] == [1]


def test_missing_values_in_sums(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    got = by_key(df.groupBy("k").agg(
        g.null_sum(F.col("v")).alias("s"), g.null_sum_distinct(F.col("v")).alias("d"),
        g.flag_sum(F.lit(None).cast("boolean")).alias("f"),
    ))
    assert (got["a"].s, got["a"].d, got["a"].f) == (2.0, 1.0, 0)
    assert (got["b"].s, got["b"].d) == (None, None)
    totals = g.group_total(df, ["k"], "v", "t").collect()
    assert sorted((r.k, r.t) for r in totals if r.k == "a") == [("a", 2.0)] * 2
    assert all(r.t is None for r in totals if r.k == "b")


def test_next_value(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)], "k string, i int, v double")
    following = {(r.k, r.i): r.next for r in g.next_value(df, ["k"], "i", "i", "next").collect()}
    assert following == {("a", 1): 2, ("a", 2): None, ("b", 1): None}


def test_unknown_counts_keep_groups_without_unknowns(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", None, 4), ("a", True, 1), ("b", False, 2)], "study_id string, s boolean, c int"
    )
    got = {r.study_id: tuple(r)[1:] for r in g.unknown_counts(df, "s", "c", [1, 2, 3, 4]).collect()}
    assert got == {"a": (1, 0, 0, 1), "b": (0, 0, 0, 0)}
    known = {(r.study_id, r.c): (r.n_positives, r.n_patients) for r in g.class_counts(df, "s", "c").collect()}
    assert known == {("a", 1): (1, 1), ("b", 2): (0, 1)}


def test_row_ranges_follow_the_sorted_table(spark):
    df = spark.createDataFrame([("b",)] * 2 + [("a",)] * 3 + [("c",)], "k string")
    got = {r.k: (r.min_index, r.max_index) for r in g.row_ranges(df, ["k"]).collect()}
    assert got == {"a": (1, 3), "b": (4, 5), "c": (6, 6)}


def test_shaping(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2)], ["id", "PR[1]", "PR_mic[1]"])
    assert sh.select_matching(df, "PR", exclude="mic", keep=["id"]).columns == ["id", "PR[1]"]
    assert sh.rename_matching(df, r"[\[\]]").columns == ["id", "PR1", "PR_mic1"]
    assert sh.select_renamed(df, {"PR[1]": "p"}).columns == ["p"]
    long = sh.to_long(df, ["id"])
    assert sorted(tuple(r) for r in long.collect()) == [(1, "PR[1]", 0.1), (1, "PR_mic[1]", 0.2)]
    assert [r.parameter for r in sh.filter_parameter(long, "^PR", exclude="mic").collect()] == ["PR[1]"]


def test_recode_keeps_or_drops_others(spark):
    df = spark.sql("SELECT * FROM VALUES ('a'), ('z'), (NULL) AS t(x)")
    assert [r.x for r in sh.recode(df, "x", {"a": "b"}).collect()] == ["b", "z", None]
    assert [r.x for r in sh.recode(df, "x", {"a": "b"}, keep_others=False).collect()] == ["b", None, None]


def test_append_and_threshold(spark):
    a, b = spark.range(2).withColumn("x", F.lit(1)), spark.range(3)
    both = sh.append(a, b)
    assert both.count() == 5 and both.where("x IS NULL").count() == 3
    assert sh.above_threshold(b, "id", sh.single(b, F.max("id")), 0.5).count() == 2


def test_deltas_and_ranks(spark):
    df = spark.createDataFrame([("m1", 5.0), ("m2", 3.5)], "m string, dic double").withColumn("p", F.lit("x"))
    assert {r.m: r.delta for r in g.delta_from_best(df, ["p"], "dic").collect()} == {"m1": 1.5, "m2": 0.0}
    assert {r.m: r.position for r in o.order_by_statistic(df, ["m"], "dic").collect()} == {"m1": 2, "m2": 1}


def test_windows_meet_points_on_bins(spark):
    windows = spark.createDataFrame([(1, 0, 5), (2, 3, 3), (3, -7, 100), (4, 9, 2), (5, None, 4)], "w int, lo int, hi int")
    points = spark.range(-10, 30).select(F.col("id").cast("int").alias("p"))
    want = {(w, p) for w, lo, hi in [(1, 0, 5), (2, 3, 3), (3, -7, 100)] for p in range(-10, 30) if lo <= p <= hi}
    for width in (1, 4, 1000):
        pairs = interval_join(windows, points, "lo", "hi", "p", width)
        assert pairs.columns == ["w", "lo", "hi", "p"] and sorted((r.w, r.p) for r in pairs.collect()) == sorted(want)


def test_values_that_should_be_one(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 10), ("a", 2, 11), ("b", 1, None), ("b", 1, 5), ("c", None, 7)], "k string, i int, v int")
    found = {r.key: (r.rule, r.n_rows, r.n_values, r.low, r.high) for r in g.constancy(df, ["k"], "v", "one v").collect()}
    assert found == {"a": ("one v", 3, 2, "10", "11"), "b": ("one v", 2, 2, "5", "5")}
    assert [r.key for r in g.constancy(df, ["k", "i"], "v", "one v").collect()] == ["b 1"]


def test_keys_of_one_beginning_are_dealt_out(spark):
    """Nearly all keys begin alike, over several cuts; buckets stay small and follow the order."""
    same = "population of the district of "
    keys = spark.range(100_000).select(F.concat(F.lit(same), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
    df = keys.union(spark.createDataFrame([("a",), (same,), (same[:8],), (same[:11],), ("zebra",), ("",)], "k string"))
    placed = o.with_beginnings(df, [], "k", most=500)
    sizes = placed.groupBy("_coarse").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("_coarse").collect()
    assert max(r.n for r in sizes) <= 500 and len(sizes) > 200
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    again = o.with_beginnings(spark.range(2000).select(F.lit("one key on all rows").alias("k")), [], "k", most=500)
    assert again.select("_coarse").distinct().count() == 1
    numbered = o.number_rows(df, ["k"]).where(F.col("k").isin("", "a", "zebra")).collect()
    assert sorted((r.k, r.rn) for r in numbered) == [("", 1), ("a", 2), ("zebra", 100_006)]
