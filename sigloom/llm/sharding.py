"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records with a seeded hash of their id and text over 2 ** 20 cells; runs of cells are buckets of a
bounded size. Equal records land in one cell, so a bucket over four times its size (a hot record, as many rows as it may
have) is split further by a hash of each row's own place in its file. Pass two shuffles each bucket in memory with the
Fisher-Yates algorithm (Spark's shuffle() on an array of sort keys) and lays the buckets end to end; the shards are equal
slices of that sequence, so their row counts differ by one at most (law `rows`). write_shards writes a folder for each
shard, in the order of the slots; consecutive buckets share a partition, which so has the rows of one shard or two.

Bounds: at most MOST_BUCKETS buckets, of BUCKET_BYTES each or what an even share of all bytes is, and MOST_PARTITIONS
partitions; 100 TB make a million buckets of 95 MB in 65,536 partitions. The table of split buckets, which is broadcast,
has a quarter of MOST_BUCKETS rows of two numbers at most, since each holds four times an even share.

Rows are numbered by file and place in it, which a retried task finds again as they were; a table that does not come
straight from Parquet files is written to the shared folder first.

Defined cases: a null text has no bytes; rows without an id are scattered by their text; rows that repeat an id are
records of their own, in the order of their content before the shuffle (of map columns: of their place); an empty table
gives no rows; columns of the input that are named bucket, shard or slot give way to the operator's own, any others are
carried along whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sigloom.llm import common as C

BUCKET_BYTES = 8 << 20
CELL_BITS, PARTITION_BITS = 20, 16
MOST_BUCKETS, MOST_PARTITIONS = 1 << CELL_BITS, 1 << PARTITION_BITS
OWN = ("bucket", "shard", "slot")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def numbered(df: DataFrame) -> DataFrame:
    """r, the row as a struct, and number, a hash of its place in the files it comes from."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r")
    place = F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("number")
    try:
        return df.select(row, place)
    except AnalysisException:
        return C.materialise(df.select(row), "rows").select("r", place)


def _before(counts: DataFrame) -> DataFrame:
    """For each partition key the rows before each of its buckets, and all rows: sums of runs of a thousand buckets, then within each run."""
    run = W.partitionBy("run").orderBy("bucket", "sub").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = counts.groupBy("run").agg(F.sum("n").alias("m"))  # a thousandth of the buckets: a thousand rows at most
    above = sums.select("run", (F.sum("m").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")).alias("base"), F.sum("m").over(W.partitionBy()).alias("total"))
    placed = counts.join(F.broadcast(above), "run").select("part", "bucket", (F.col("base") + F.sum("n").over(run) - F.col("n")).alias("before"), "total")
    # a partition key has 2 ** (CELL_BITS - PARTITION_BITS) buckets at most
    return placed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "before"))).alias("before"), F.max("total").alias("total"))


def external_shuffle(df: DataFrame, shards: int = 16, seed: int = 42, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, all columns of df, shard and slot (gapless from 0 in each shard)."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in OWN])
    rows = numbered(df)
    of, words = F.col(f"r.`{key}`"), F.col(f"r.`{text}`")
    content = F.xxhash64(F.lit(seed + 1), words)
    rows = rows.select("r", "number", F.pmod(F.xxhash64(F.lit(seed), of, content), F.lit(MOST_BUCKETS)).cast("int").alias("cell"))
    size = F.sum(F.coalesce(F.octet_length(words), F.lit(0)) + 64)
    cells = C.materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")), "cells")

    total = cells.agg(F.sum("bytes")).first()[0] or 0
    bits = min(CELL_BITS, max(0, -(-total // bucket_bytes) - 1).bit_length())
    most = max(bucket_bytes, -(-total >> bits))
    bucket = F.shiftright("cell", CELL_BITS - bits).alias("bucket")
    pieces = F.when(F.sum("bytes") > 4 * most, F.ceil(F.sum("bytes") / most).cast("int")).alias("pieces")
    buckets = C.materialise(cells.groupBy(bucket).agg(F.sum("n").alias("n"), pieces), "buckets")
    C.discard(cells)
    hot = buckets.where("pieces is not null").select("bucket", "pieces")

    scattered = rows.select("r", "number", bucket)
    counts = buckets.where("pieces is null").select("bucket", F.lit(0).alias("sub"), "n")
    if hot.isEmpty():
        scattered = scattered.withColumn("sub", F.lit(0))
    else:
        sub = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(seed + 2), "number"), "pieces").cast("int"))
        scattered = scattered.join(F.broadcast(hot), "bucket", "left").withColumn("sub", sub)
        counts = counts.unionByName(scattered.where("pieces is not null").groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("n")))
    # one key for what shares a partition: consecutive buckets, or a piece of a hot one
    part = F.shiftleft(F.shiftright("bucket", max(0, bits - PARTITION_BITS)).cast("long"), 32) + F.col("sub")
    places = _before(counts.withColumn("part", part).withColumn("run", F.shiftright("bucket", 10)))

    # One exchange; the buckets of a partition are shuffled in their own order, so that the random numbers depend on the
    # seed and the buckets alone, and not on the cluster.
    plain = [F.col(f"r.`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    record = F.struct(of.alias("k"), F.octet_length(words).alias("s"), F.xxhash64(*plain).alias("w"), F.col("number").alias("i"), F.col("r"))
    grouped = (
        scattered.select(part.alias("part"), "bucket", record.alias("row"))
        .repartition(1 << min(bits, PARTITION_BITS), "part")
        .groupBy("part", "bucket")
        .agg(F.collect_list("row").alias("rows"))
        .sortWithinPartitions("part", "bucket")
    )
    order = F.shuffle(F.array_sort(F.transform("rows", lambda x, at: F.struct(x["k"], x["s"], x["w"], x["i"], at.alias("at")))), seed)
    shuffled = (
        grouped.withColumn("order", order)
        .withColumn("rows", F.transform("order", lambda o: F.get("rows", o["at"])["r"]))
        .join(places.hint("merge"), "part")  # the rows stay where the exchange has put them
        .select("bucket", F.try_element_at("before", "bucket").alias("before"), "total", F.posexplode("rows").alias("at", "r"))
        .select("bucket", "total", (F.col("before") + F.col("at")).alias("pos"), "r")
    )
    shard = F.expr(f"cast(((pos + 1) * {shards} - 1) div total as int)")
    placed = shuffled.select("bucket", "r", "pos", "total", shard.alias("shard")).select("bucket", "r", "shard", F.expr(f"pos - (shard * total) div {shards}").alias("slot"))
    return placed.select("bucket", *[F.col(f"r.`{c}`").alias(c) for c in df.columns], "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder for each shard; each task writes the buckets it shuffled, in order of their slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_shards wrote, for the schema of what it was given."""
    return spark.read.schema(schema).parquet(path).select(*[f"`{f.name}`" for f in schema.fields])


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows` with 16 shards over all documents, written to the shared folder and read back."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.work_dir(spark, "shards")
    shuffled = external_shuffle(docs)
    write_shards(shuffled, out)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, out, shuffled.schema).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
