import zlib

import pytest

from sigloom.llm import sharding as S

SCHEMA = "doc_id long, text string, source string"


def rows(n):
    return [(i, None if i % 7 == 0 else f"text {i % 11} " * (i % 5), "hot" if i % 3 else None) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 1000])
def test_rows_law(spark, n):
    df = spark.createDataFrame(rows(n), SCHEMA)
    got = S.external_shuffle(df, bucket_bytes=4096).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == sorted(rows(n))
    sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in sizes.values())
    counts = [len(v) for v in sizes.values()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n


def test_seed_decides(spark):
    df = spark.createDataFrame(rows(500), SCHEMA)
    place = lambda d, seed: {r.doc_id: (r.shard, r.slot) for r in S.external_shuffle(d, seed=seed, bucket_bytes=4096).collect()}
    first = place(df, 1)
    assert first == place(df.repartition(7), 1) != place(df, 2)
    order = [i for i, _ in sorted(first.items(), key=lambda x: x[1])]
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) / 500 > 100  # neighbours are spread


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a", "x"), (None, "a", "x"), (None, None, None), (1, "b", "x"), (1, "b", "x"), (1, "c", "x")], SCHEMA)
    got = S.external_shuffle(df).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
    clash = S.external_shuffle(df.withColumnRenamed("source", "Shard").selectExpr("*", "1 AS total", "2 AS pos", "3 AS rows", "4 AS n", "'b' AS bucket"))
    assert clash.columns == ["bucket", "doc_id", "text", "total", "pos", "rows", "n", "shard", "slot"] and {r.total for r in clash.collect()} == {1}


def test_any_names_and_maps(spark):
    """Columns named like those that the operator makes on its way, and map columns, come through."""
    names = ["_total", "_pos", "_k", "_row", "r", "number", "cell", "pieces", "sub", "part", "run", "before", "total", "pos", "at", "order", "rows", "_metadata", "i", "m"]
    df = spark.createDataFrame(rows(60), SCHEMA).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names], "map('a', doc_id) AS `map`", "array(map(1, text)) AS `maps`")
    out = S.external_shuffle(df, bucket_bytes=2048)
    assert out.columns == ["bucket", *df.columns, "shard", "slot"]
    got = out.collect()
    assert len(got) == 60 and all(r[n] == n for r in got for n in names) and all(r["map"] == {"a": r.doc_id} and r.maps == [{1: r.text}] for r in got)


@pytest.mark.parametrize("text", ["'same'", "concat('text ', id)"])
def test_hot_id(spark, text):
    """5,000 rows of one id, with one text or many, go to many buckets, none much over its size."""
    df = spark.range(5000).selectExpr("7 AS doc_id", f"{text} AS text")
    got = S.external_shuffle(df, bucket_bytes=4096).collect()
    size = {}
    for r in got:
        size[r.bucket, r.shard] = size.get((r.bucket, r.shard), 0) + len(r.text) + 64
    assert len(got) == 5000 and sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s in range(16) for i in range(len([r for r in got if r.shard == s])))
    where = S.external_shuffle(df, bucket_bytes=4096).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(where) > 20 and max(r["count"] for r in where) < 700


def test_permutation_replayed(spark, tmp_path):
    """Each bucket is what Spark's shuffle() makes of its records in order of id, size and content, the buckets end to end."""
    df = spark.createDataFrame(rows(400), SCHEMA).select("doc_id", "text")
    got = S.external_shuffle(df, seed=9, bucket_bytes=4096).collect()
    n = max(r.bucket for r in got) + 1
    cell = df.selectExpr("doc_id", "text", f"cast(pmod(xxhash64(9, doc_id, xxhash64(10, text)), {S.MOST_BUCKETS}) AS int) AS cell").collect()
    bits = (-(-sum(len((r.text or "").encode()) + 64 for r in cell) // 4096) - 1).bit_length()
    buckets = {}
    for r in cell:
        buckets.setdefault(r.cell >> (S.CELL_BITS - bits), []).append(r.doc_id)
    assert n > 4 and {b: sorted(r.doc_id for r in got if r.bucket == b) for b in buckets} == {b: sorted(x) for b, x in buckets.items()}
    # where buckets stand, and Fisher-Yates within each: the partitions hold buckets in order, each with one generator
    parts = spark.createDataFrame([(b, sorted(x)) for b, x in buckets.items()], "bucket int, ids array<bigint>").selectExpr("*", "shiftleft(cast(bucket AS bigint), 32) AS part")
    replay = parts.repartition(1 << bits, "part").sortWithinPartitions("part").selectExpr("bucket", "shuffle(ids, 9) AS ids").collect()
    want = [i for r in sorted(replay, key=lambda r: r.bucket) for i in r.ids]
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == want


def test_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, None), (2, "y", None), (3, None, "z")], SCHEMA)
    assert sorted((r.doc_id, len(r.text or ""), r.shard) for r in S.external_shuffle(df, shards=3).collect()) != [] and S.external_shuffle(df, shards=3).select("shard").distinct().count() == 3


def test_write(spark, tmp_path):
    df = spark.createDataFrame(rows(300), SCHEMA)
    S.write_shards(S.external_shuffle(df, bucket_bytes=4096), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 300 and back.select("shard").distinct().count() == 16


def test_query(spark):
    got = S.op5_external_shuffle(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
