"""Boxes that overlap, against plain loops; many equal boxes among them."""

import random

import duckdb
from pyspark.sql import functions as F

from gridloom.operators import geometry
from gridloom.plans import page_oracles, page_queries

NAMES = "image string, id long, x0 double, y0 double, x1 double, y1 double"


def _some(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.choice((-17.0, -16.0, -3.5, 0.0, 15.5, 16.0, 31.0)), r.choice((-1.0, 0.0, 8.0, 16.0))
        rows.append((r.choice("pq"), r.randrange(n), x, y, x + r.choice((-2.0, 0.0, 0.5, 1.0, 20.0)), y + r.choice((0.0, 1.0, 8.0, 40.0))))
    return [*rows, ("p", 3, None, 0.0, 1.0, 1.0), ("p", None, 0.0, 0.0, 1.0, 1.0), (None, 4, 0.0, 0.0, 1.0, 1.0)]


def _pairs(rows, meets):
    return sorted((p[0], p[1], q[1]) for p in rows for q in rows if None not in p and None not in q and p[0] == q[0] and p[1] < q[1] and meets(p, q))


def _touch(p, q):
    return p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5]


def test_overlaps_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 3)
    rows = _some(300, 5)
    got = geometry.box_overlaps(spark.createDataFrame(rows, NAMES), 16, ["image"])
    assert sorted(map(tuple, got.collect())) == _pairs(rows, _touch)


def test_overlaps_with_a_condition_on_the_pair(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 3)
    rows = _some(300, 6)
    got = geometry.box_overlaps(spark.createDataFrame(rows, NAMES), 16, ["image"], lambda s, t: F.col(f"{s}_x1") < F.col(f"{t}_x1") + F.col(f"{t}_y0"))
    assert sorted(map(tuple, got.collect())) == _pairs(rows, lambda p, q: _touch(p, q) and p[4] < q[4] + q[3])


def test_pairs_of_boxes_in_one_place_are_made_by_many_tasks(spark):
    n = 3000
    boxes = spark.range(n).select(F.lit("p").alias("image"), "id", *[F.lit(v).alias(c) for c, v in (("x0", 1.0), ("y0", 1.0), ("x1", 2.0), ("y1", 2.0))])
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        sizes = [r["count"] for r in geometry.box_overlaps(boxes, 16, ["image"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sum(sizes) == n * (n - 1) // 2
    assert max(sizes) < sum(sizes) / 4


def test_overlapping_ids_equal_plain_loops(spark):
    for n, seed in ((12, 7), (40, 8), (200, 9)):
        rows = _some(n, seed)
        inside = lambda p, q: p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]
        want = {(p[0], p[1]) for p in rows for q in rows if None not in p and None not in q and p[0] == q[0] and p[1] != q[1] and inside(p, q)}
        got = [tuple(r) for r in geometry.overlapping(spark.createDataFrame(rows, NAMES), 16, ["image"]).collect()]
        assert sorted(got) == sorted(want)


def test_overlap_rate_meets_each_of_many_equal_boxes_once(spark, tmp_path):
    """Before, 1.8e9 pairs of ids were made for this."""
    n = 60000
    spark.range(n).select((F.col("id") * 500).alias("p_partkey"), F.lit(3).alias("p_size")).union(spark.sql("select 1L, 3")).write.parquet(f"{tmp_path}/part.parquet")
    assert page_queries.rect_overlap_rate(spark, str(tmp_path)).collect() == [(round(100 * n / (n + 1), 6),)]


def test_crossings_equal_sql_for_equal_ids_and_sizes_below_zero(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice((0, 500, 500, 1000, 7, 507, -300)) + 3500 * r.randrange(4), r.randrange(-50, 51)) for _ in range(400)] + [(None, 3), (500, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, page_queries.segment_crossings(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(page_oracles.SQL["segment_crossings"]).fetchall()
    assert len(want) > 1000 and got == sorted(want)


def test_crossings_carry_ends_through_one_join(spark, tmp_path):
    """Before, each pair of boxes was joined with both of its boxes again."""
    spark.createDataFrame([(500 * i, 48) for i in range(50)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = page_queries.segment_crossings(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert out.count() == 50 * 49 // 2
