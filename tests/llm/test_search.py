"""Search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from burdenflow.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dim string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(4)


def brute(spark, rows, k):
    """Vectors as Spark holds them: single precision."""
    held = [(r.vec_id, r.embedding) for r in make(spark, rows).collect()]
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in held if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in fine if i % 50 == 0}:
        vector = min(v for i, v in fine if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in fine if i != q and len(v) == len(vector))
        for rank, (score, i) in enumerate(scores[:k], 1):
            out[q, rank] = (i, -score)
    return out


@pytest.mark.parametrize("k,shard,tile,fan", [(5, 64, 3, 2), (3, 2048, 256, 16), (40, 10, 2, 3)])
def test_the_best_rows_of_every_query(spark, k, shard, tile, fan):
    random.seed(k)
    rows = [(i, [random.uniform(-1, 1) for _ in range(6)]) for i in range(0, 400)]
    rows += [(i, [0.5] * 6) for i in range(400, 500)] + [(7, [0.5] * 6)] * 3 + [(100, [0.1] * 6), (None, [0.9] * 6)]
    rows += [(600, None), (650, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (700, [float("nan")] * 6), (701, [float("inf")] * 6), (750, []), (800, [1.0, 2.0]), (801, [1.0, -2.0])]
    got = search.search(make(spark, rows), F.col("vec_id") % 50 == 0, k, shard=shard, tile=tile, fan=fan).collect()
    assert len(got) == len({(r.query_id, r.rank) for r in got})
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute(spark, rows, k)


def test_empty_table_and_lonely_query(spark):
    assert search.search(make(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert search.search(make(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_vectors_too_long_for_exact_sums_in_doubles(spark):
    random.seed(4)
    rows = [(i, [random.uniform(-1, 1) * 10 ** random.choice([0, 0, 3, 5, 6]) for _ in range(5)]) for i in range(300)]
    rows += [(300, [1e6, -1e6, 0.004, 1.0, 0.0]), (301, [1e6, 1e6, 0.5, 1.0, 0.0]), (302, [1e6, 1e6, 1.5, 0.0, 0.0])]
    got = search.search(make(spark, rows), F.col("vec_id") % 50 == 0, 7, shard=40, tile=2, fan=2).collect()
    want = brute(spark, rows, 7)
    assert max(abs(score) for _, score in want.values()) > 2**53
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == want


def test_scores_beyond_63_bits_count_as_the_nearest(spark):
    rows = [(50, [3e38, 3e38]), (1, [1.0, 0.0]), (2, [3e38, 3e38]), (3, [-3e38, 0.0]), (4, [3e38, -3e38]), (5, [0.0, 0.0]), (6, [3e38, 0.0])]
    got = search.search(make(spark, rows), F.col("vec_id") % 50 == 0, 9).orderBy("rank").collect()
    most = 2**63 - 1
    assert [(r.vec_id, r.score) for r in got] == [(1, most), (2, most), (6, most), (4, 0), (5, 0), (3, -most)]
    double = spark.createDataFrame([(50, [1e308, 1.0]), (1, [0.0, 2.0]), (2, [-1e308, 1e308])], "vec_id long, embedding array<double>")
    got = search.search(double, F.col("vec_id") % 50 == 0, 9).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**17), (2, -most)]


def test_what_is_handed_on_does_not_grow_with_the_shards(spark, monkeypatch):
    random.seed(8)
    rows = [(i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(800)]
    written, keep = [], search.keep

    def counted(df, name):
        written.append((kept := keep(df, name)).count())
        return kept

    monkeypatch.setattr(search, "keep", counted)
    got = search.search(make(spark, rows), F.col("vec_id") % 50 == 0, 3, shard=10, tile=4, fan=2).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute(spark, rows, 3)
    # 16 queries and 80 shards: no table has more rows than the result
    assert max(written) <= 16 * 3


def test_queries_that_a_cell_cannot_hold_are_dealt_out(spark, monkeypatch):
    random.seed(9)
    rows = [(i, [random.uniform(-1, 1) for _ in range(random.choice([3, 5]))]) for i in range(900)]
    monkeypatch.setattr(search, "HELD", 100)
    cut = search.grid(make(spark, rows), F.col("vec_id") % 50 == 0, 4, 50, 1, 8).collect()
    assert {r.dim for r in cut} == {3, 5} and all(r.query_groups > 4 and r.groups == 1 for r in cut)
    got = search.search(make(spark, rows), F.col("vec_id") % 50 == 0, 4, shard=50, tile=1, fan=2).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == brute(spark, rows, 4)


def test_cells_are_as_many_as_wanted_and_copies_few(spark):
    vectors = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5)).alias("embedding"))
    (one,) = search.grid(vectors, F.col("vec_id") % 50 == 0, 5, 100, 10, 200).collect()
    # 2,000 queries: 2 copies of all candidates and 100 of all queries
    assert (one.dim, one.query_groups, one.groups) == (1, 2, 100)
