import zlib

import numpy as np

from tabsynth.llm import sharding


def one_jump(key, n):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop_and_moves_little():
    keys = np.arange(20_000, dtype=np.int64) * 7_919 + 13
    for n in (1, 2, 16, 17, 1000):
        got = sharding.jump(keys, n)
        assert got.tolist()[:500] == [one_jump(int(k), n) for k in keys[:500]]
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert (b[a != b] == 16).all() and abs((a != b).mean() - 1 / 17) < 0.01


def test_documents(spark):
    rows = [(i, f"text é {i % 7}", 5) for i in range(400)] + [(3, None, 1), (3, "", 1), (None, "x", 1), (7, "text é 0", 5), (7, "text é 0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for d, x, _ in rows)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.grown_shard in (r.shard, 16) and r.law == "key"
    again = {(str(r.doc_id), r.text_crc32, r.shard) for r in sharding.shard_documents(docs.repartition(3)).collect()}
    assert again == {(str(r.doc_id), r.text_crc32, r.shard) for r in got}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
    sharding.write_shards(docs, f"{tmp_path}/out", "doc_id", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} <= {0, 1, 2, 3}
