import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from calibra.llm import sharding


def docs(spark, n=4000, seed=2):
    rng = random.Random(seed)
    rows = [(i, "é" * rng.randint(0, 400), rng.choice("abc"), "hot" if rng.random() < .4 else f"s{rng.randrange(9)}")
            for i in range(n)] + [(None, None, None, None)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_shards_near_equal_and_slots_gapless(spark):
    d = docs(spark).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(d, 40).collect()
    assert len(rows) == 4003
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(40))
    mean = sum(size.values()) / 40
    assert max(size.values()) - min(size.values()) < 4 * 816 and abs(max(size.values()) / mean - 1) < 0.05
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                          for r in docs(spark).collect())


def test_first_split_is_the_weighted_median_of_the_widest_dimension(spark):
    at = sharding.stored(sharding.points(docs(spark)))
    rows = sharding.kd_tree(at, 2).collect()
    dims = [c for c in at.columns if c.startswith("__d")]
    wide = max(dims, key=lambda c: max(r[c] >> 30 for r in rows) - min(r[c] >> 30 for r in rows))
    order = sorted(rows, key=lambda r: r[wide])
    half = sum(r["size"] for r in rows) / 2
    left = [r["__node"] for r in order].index(1)
    assert all(r["__node"] == (0 if i < left else 1) for i, r in enumerate(order))
    assert abs(sum(r["size"] for r in order[:left]) - half) <= max(r["size"] for r in rows)


def test_few_and_equal_rows(spark, frame):
    assert sharding.shard_documents(frame([])).collect() == []
    rows = spark.createDataFrame([(1, "x", "en", "s")] * 5, "doc_id long, text string, lang string, source string")
    got = sharding.shard_documents(rows, 3).collect()
    assert len(got) == 5 and all(0 <= r.shard < 3 for r in got)
    assert len({(r.shard, r.slot) for r in got}) == 5
