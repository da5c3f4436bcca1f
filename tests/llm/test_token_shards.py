import numpy as np
import pytest

from planloom.llm import token_shards as S

SCHEMA = "doc_id long, text string, slot int, ids string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 4096, 5001])
def test_permutation(n):
    x = np.arange(n)
    y = S.permute(x, n, key=99)
    assert sorted(y.tolist()) == x.tolist()
    assert S.permute(y, n, key=99, inverse=True).tolist() == x.tolist()
    if n > 100:
        assert (y == S.permute(x, n, key=98)).mean() < 0.05 and abs(np.corrcoef(x, y)[0, 1]) < 0.15


def test_shards_give_back_every_document(spark):
    docs = [(k, "é text " * k + str(k)) for k in range(120)] + [(200, None), (201, ""), (202, "y" * 64), (203, "z" * 50_000), (None, "no id"), (5, "é text " * 5 + "5"), (6, "another text of 6")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(4)
    table, index = S.materialise(df, key=3, length=64, per_shard=100)
    shards = sorted(table.collect(), key=lambda r: r.shard)
    total = sum(len((t or "").encode()) // 64 + 1 for _, t in docs)
    assert [r.shard for r in shards] == list(range(-(-total // 100))) and all(r.first_slot == 100 * r.shard and r.stride == 128 and len(r.payload) == r.n_sequences * 128 for r in shards)
    assert sum(r.n_sequences for r in shards) == total
    payload = {r.shard: bytes(r.payload) for r in shards}
    places = index.collect()
    assert sorted(r.slot for r in places) == list(range(total))
    found = {}
    for r in places:
        found.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(payload[r.shard][r.offset : r.offset + 128], "<u2")))
    for i, t in docs:
        if i in (5, 6):
            continue
        ids = np.concatenate([p for _, p in sorted(found[i], key=lambda x: x[0])])
        end = int(np.flatnonzero(ids == S.END)[0])
        assert bytes((ids[:end] - S.FIRST_BYTE).astype(np.uint8)).decode() == (t or "") and not ids[end + 1 :].any()
    assert len(found[5]) == 2 and len(found[6]) == 2
    again, _ = S.materialise(df.repartition(2), key=3, length=64, per_shard=100)
    assert {r.shard: bytes(r.payload) for r in again.collect()} == payload  # the order does not depend on how rows are stored
    rest = sorted(S.read_from(table, 150, length=64, per_shard=100).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rest] == list(range(150, total))
    assert rest[0].ids == np.frombuffer(payload[1][50 * 128 : 51 * 128], "<u2").tolist()


def test_no_rows(spark):
    table, index = S.materialise(spark.createDataFrame([], SCHEMA))
    assert table.count() == index.count() == 0
