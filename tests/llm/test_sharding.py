import zlib

from pyspark.sql import functions as F

from docloom.llm import sharding


def shard(df, n=16, **k):
    df = df.withColumn("b", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint"))
    return sharding.histogram_shard(df, n, F.col("b"), F.coalesce("text", F.lit("")), **k).collect()


def check(rows, n, slack):
    size = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(n)]
    mean = sum(size) / n
    assert max(abs(s - mean) for s in size) <= slack, size
    for k in range(n):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_query(spark, sf, rows):
    got = sharding.op3_histogram_shard(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    assert all(r["size"] == len(rows[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]].encode()) for r in got)
    check(got, 16, max(r["size"] for r in got))


def test_hot_group_is_split_and_small_groups_are_not(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot text that repeats', concat('text ', cast(pmod(xxhash64(id), 1500) as string), repeat('x', 10))) AS text")
    got = shard(df, range_rows=50)
    check(got, 16, 120)
    cut = {}
    for r in got:
        cut.setdefault(r["text"], set()).add(r["shard"])
    assert len(cut.pop("hot text that repeats")) >= 5
    assert sum(len(s) > 1 for s in cut.values()) <= 16


def test_more_ranges_than_shards_keep_slots_gapless(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('a', cast(id % 50 as int)) AS text")
    check(shard(df, 4, range_rows=40), 4, 500)


def test_splitters_meet_the_tolerance_whatever_the_key(spark):
    """Hot hashes, doc_ids far apart and close together, one text of a tenth of all bytes: each splitter is the nearest."""
    n = 4000
    df = spark.range(n).selectExpr("if(id % 3 = 0, 7L, xxhash64(id)) AS h", "if(id % 2 = 0, id, id * 2305843009213) AS d", "1 + id % 90 AS size")
    keys = sorted((r["h"], r["d"], r["size"]) for r in df.collect())
    total = sum(k[2] for k in keys)
    found = sharding.find_splitters(df, total, 16, 0.0005)
    for k, (key, rows, size) in enumerate(found, 1):
        assert rows == sum((h, d) < key for h, d, _ in keys) and size == sum(s for h, d, s in keys if (h, d) < key)
        assert abs(size - total * k // 16) <= 90
    ends = sharding.find_ranges(df, found, n, 30)
    assert ends == sorted(ends) and {f[0] for f in found} <= {e[0] for e in ends}
    assert max(b[1] - a[1] for a, b in zip(ends, ends[1:], strict=False)) <= 30


def test_one_very_long_text(spark):
    df = spark.createDataFrame([(k, "x" * (3_000_000 if k == 5 else 50)) for k in range(400)], "doc_id long, text string")
    got = shard(df)
    assert len(got) == 400 and sum(r["size"] for r in got) == 3_000_001 + 399 * 51
    for k in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, 1), (1, None, 2), (1, "", 3), (1, "", 3), (2, "b" * 1000, 4)], "doc_id long, text string, shard int")
    got = shard(df, 4)
    assert len(got) == 5 and {r["size"] for r in got} == {1, 1001}
    assert shard(df.limit(0), 4) == []
