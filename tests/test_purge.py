import os

from planloom.operators import keyed as K
from planloom.staging import Stage


def files(path):
    return {d: sorted(n for n in os.listdir(f"{path}/{d}") if n.endswith(".parquet")) for d in os.listdir(path) if d.startswith("part=")}


def test_purge_touches_the_folders_of_its_projects_only_and_can_run_again(spark):
    root = Stage(spark, "purge_test").root
    rows = [(p, i) for p in range(30) for i in range(3)]
    for name in ("elements", "edges"):
        K.store_by_project(spark.createDataFrame(rows, "project_id long, id long"), f"{root}/{name}", 8)
    gone = spark.createDataFrame([(4,), (4,), (17,), (99,), (None,)], "project_id long")
    before = files(f"{root}/elements")
    hit = {f"part={r[0]}" for r in gone.where("project_id in (4, 17, 99)").select(K.part_of(8)).collect()}
    for _ in range(2):
        K.purge_stored(spark, [f"{root}/elements", f"{root}/edges"], gone, 8)
        for name in ("elements", "edges"):
            got = sorted(map(tuple, spark.read.parquet(f"{root}/{name}").select("project_id", "id").collect()))
            assert got == [r for r in rows if r[0] not in (4, 17)]
    after = files(f"{root}/elements")
    assert {d for d in before if before[d] != after.get(d)} <= hit and all(before[d] == after[d] for d in before if d not in hit)
    # a folder that loses all its projects goes
    K.purge_stored(spark, [f"{root}/edges"], spark.createDataFrame([(p,) for p in range(30)], "project_id long"), 8)
    assert files(f"{root}/edges") == {}
