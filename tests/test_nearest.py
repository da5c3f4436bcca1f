from planloom.operators import spatial, topology


def test_pairs_of_nearest_are_never_sorted_and_ties_go_to_the_smallest_id(spark):
    left = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 50.0, -0.0), (3, 1, 0.0, 0.0)], "id long, project_id long, x double, y double")
    right = spark.createDataFrame([("b", 0, 3.0, 4.0), ("a", 0, 4.0, 3.0), ("c", 0, 50.0, 6.0), ("d", 0, 9.0, 0.0)], "node string, project_id long, x double, y double")
    for rings in ((), (0.25, 0.6)):
        hit = spatial.nearest(left, right, 10.0, on=["project_id"], rid="node", rings=rings, distinct=True)
        assert sorted(tuple(r) for r in hit.select("a.id", "a.x", "b.node", "distance").collect()) == [(1, 0.0, "a", 5.0), (2, 50.0, "c", 6.0)]
    plan = hit._jdf.queryExecution().sparkPlan().toString()
    # the pairs meet a hash aggregate of their distance; only the rows at that distance are sorted
    assert "HashAggregate" in plan and "partial_min(distance" in plan


def test_runs_of_a_graph_take_no_shuffle(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0, 3.0, 4.0), (2, 0, 3.0, 4.0, 3.0, 4.0)], "id long, project_id long, x1 double, y1 double, x2 double, y2 double")
    symbols = spark.createDataFrame([(7, 0, 1.0, 0.0, "valve", "plumbing")], "id long, project_id long, x double, y double, kind string, category string")
    edges = topology.build_graph(lines, symbols)[1]
    assert sorted(tuple(r)[:4] for r in edges.collect()) == [
        ("J:0:0:0", "J:0:3:4", "run", 5.0), ("J:0:3:4", "J:0:3:4", "run", 0.0), ("S:7", "J:0:0:0", "connects_to", 1.0)]
    assert "Exchange" not in edges.where("edge_type = 'run'").select("line_id", "length")._jdf.queryExecution().executedPlan().toString()
