import datetime as dt
import random

import pytest

from planloom.operators import relations as R
from planloom.staging import Stage
from planloom.streaming import jobs as J

FACTS = "project_id long, fact_type string, key string, id long, confidence double, created_at timestamp, expires_at timestamp, value string"


def at(hour):
    return None if hour is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_facts_expire_with_the_clock_and_go_on_after_a_restart(spark):
    """Each file is a run of its own, started again from the checkpoint of the one before."""
    root = Stage(spark, "facts_test").root
    hours = [
        [("a", 1, 0, 5), ("a", 2, 1, 9), ("b", 3, 0, None), ("c", 4, 2, 3)],  # clock 2
        [("a", 5, 1, 2), ("d", 6, 4, None)],  # clock 4: c expires; a's older fact changes nothing
        [("e", 7, 10, 11)],  # clock 10: a expires
        [("c", 8, 10.5, 12), ("a", 9, 0.5, None)],  # c is set anew; a's old fact comes late and has no newer rival in the state
        [("f", 10, 20, 21), ("f", 11, 20, 30), (None, 12, 20, None)],  # clock 20: c and e expire; of equal times the larger id
    ]
    live = [{"a": 2, "b": 3, "c": 4}, {"a": 2, "b": 3, "d": 6}, {"b": 3, "d": 6, "e": 7}, {"b": 3, "d": 6, "e": 7, "c": 8}, {"b": 3, "d": 6, "f": 11, None: 12}]
    for k, (rows, want) in enumerate(zip(hours, live)):
        df = spark.createDataFrame([(1, "t", key, i, 0.5, at(c), at(e), None) for key, i, c, e in rows], FACTS)
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = J.file_stream(spark, f"{root}/in", df.schema)
        J.fact_state(stream, f"{root}/out")
        got = {r.key: r.id for r in J.facts_now(spark.read.parquet(f"{root}/out")).collect()}
        if k == 3:
            got.pop("a", None)  # behind the watermark: Spark may drop such a row or take it
        assert got == want, k


def test_edges_go_on_after_a_failure_and_equal_a_full_recompute(spark, monkeypatch):
    rng = random.Random(2)
    row = lambda i, x=None: (i, i % 2, f"L{rng.randrange(3)}", *(p := (x or rng.uniform(0, 30), rng.uniform(0, 30), 0.0)), p[0] - 1, p[1] - 1, p[0] + 1, p[1] + 1)
    schema = "id long, project_id long, layer string, x double, y double, z double, min_x double, min_y double, max_x double, max_y double"
    base = [row(i) for i in range(40)]
    df = spark.createDataFrame(base, schema)
    root = Stage(spark, "edges_test").root
    now = {r[0]: r for r in base}
    for _ in range(5):
        moved = [row(i) for i in rng.sample(range(45), 6)]
        now |= {r[0]: r for r in moved}
        spark.createDataFrame(moved, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    edges = R.all_edges(df, 4.0, 12)
    stream = lambda: J.file_stream(spark, f"{root}/in", df.schema, files_per_trigger=1)
    write, fail = J.ChangeLog.write, [True]

    def broken(self, changes, batch):
        write(self, changes, batch)
        if batch == 2 and self.path.endswith("edges") and fail.pop():
            raise RuntimeError("lost between the two logs")

    monkeypatch.setattr(J.ChangeLog, "write", broken)
    with pytest.raises(Exception, match="lost between"):
        J.incremental_edges(stream(), df, edges, 4.0, 12, f"{root}/state", compact_every=2)
    monkeypatch.setattr(J.ChangeLog, "write", write)
    table, got = J.incremental_edges(stream(), df.limit(0), edges.limit(0), 4.0, 12, f"{root}/state", compact_every=2)
    assert sorted(map(tuple, table.select(*df.columns).collect())) == sorted(now.values())
    want = R.all_edges(spark.createDataFrame(list(now.values()), schema), 4.0, 12)
    whole = lambda df: sorted((*r[:4], r[4] if r[4] is None else round(r[4], 6)) for r in df.select(*J.EDGE_KEY, "distance").distinct().collect())
    assert whole(got) == whole(want)
    parts, lines = J.edge_logs(spark, f"{root}/state")
    assert lines.folders("snap") and len(lines.folders("batch")) < 5
