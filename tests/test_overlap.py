from pyspark.sql import functions as F

from planloom.operators import spatial

BOX = ["min_x", "min_y", "max_x", "max_y"]


def test_small_boxes_look_only_where_the_other_table_has_boxes(spark):
    schema = "id long, min_x double, min_y double, max_x double, max_y double"
    small = spark.createDataFrame([(i, i * 7.0, 0.0, i * 7.0 + 1 + i % 60, 0.0) for i in range(300)] + [(900, None, 0.0, 1.0, 1.0)], schema)
    flat = spark.createDataFrame([(i, i * 50.0, 0.0, i * 50.0 + 250, 4.0) for i in range(-5, 40)] + [(900, 0.0, 0.0, None, 1.0)], schema)
    whole = small.where("min_x is not null").collect(), flat.where("max_x is not null").collect()
    want = sorted((a[0], b[0]) for a in whole[0] for b in whole[1] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    pairs = spatial.overlap_pairs(small, flat, BOX)
    assert sorted(tuple(r) for r in pairs.select("a.id", "b.id").collect()) == want
    sizes = spatial._sizes(0, flat, BOX, spatial.STEP)
    probes = spatial._probe(small, "a", BOX, [], sizes, 0.0, False, spatial.STEP).where(F.col("a.id") < 900)
    # one level of the other table, one cell on the flat axis but at its border, at most two on the long one; before: six levels
    assert probes.count() < 300 * 4
    home = spatial._home(small, "a", BOX, [], 0.0, 1)
    assert not any(f.nullable for f in home.schema if f.name in ("_lv", "_c0", "_c1"))
