"""Two-pass external shuffle into shards (operator 7).

Pass 1 scatters whole records uniformly into buckets by a seeded hash; the
number of buckets follows from the total bytes, so a bucket fits in memory.
Pass 2 puts each bucket in a canonical order, Fisher-Yates shuffles it (the
built-in ``shuffle`` function draws that permutation) and writes it.  The
buckets, in order, form one random order of all records; shard ``s`` of
``n`` is the ``s``-th of ``n`` contiguous stretches of it, so the row counts
of shards differ by at most one (law ``rows``).

Defined results: a null text is an empty one of size 1; rows with a null or
repeated doc_id, and repeated rows, are records like any other; an empty
table gives no rows.  A record's bucket depends on its doc_id, the hash of
its text and a running number within its input partition, so neither equal
ids nor equal rows meet in one bucket.  Extra columns of the input are not
carried (the shard files hold ``columns``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import maybe_broadcast, prefix_sums, read_table, stage_path

LAW = "rows"


def external_shuffle(docs: DataFrame, n_shards: int = 16, seed: int = 17, bucket_bytes: int = 8 << 20,
                     columns: tuple[str, ...] = ("doc_id", "text"), path: str | None = None) -> DataFrame:
    """Shuffle the records through written buckets and return them with their
    place: ``columns`` plus size, position, shard, slot.

    ``path`` (default: a new folder in the shared storage) holds the bucket
    files; a bucket is written once, in its shuffled order.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    n_buckets = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // bucket_bytes))
    path = path or stage_path(spark, "buckets")

    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id())
    record = F.struct(F.col("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)], F.col("_size"))
    scattered = (docs.select(*columns, size.alias("_size"), key.alias("_key"))
                     .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key")), F.lit(n_buckets))))
    # One shuffle of the records; a partition receives four whole buckets, by number
    # (grouping by that number too needs no other shuffle).
    scattered = scattered.withColumn("_four", F.floor(F.col("_bucket") / 4).cast("int"))
    (scattered.repartitionById(-(-n_buckets // 4), F.col("_four")).groupBy("_four", "_bucket")
              .agg(F.sort_array(F.collect_list(record)).alias("_rows"))
              .sortWithinPartitions("_bucket")
              .withColumn("_rows", F.shuffle("_rows", seed + 2))
              .select("_bucket", F.posexplode("_rows").alias("_pos", "_r"))
              .select("_bucket", "_pos", *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(columns)],
                      F.col("_r._size").alias("size"))
              .write.parquet(path))
    return place(spark.read.parquet(path), n_shards)


def place(buckets: DataFrame, n_shards: int) -> DataFrame:
    """Position in the global order, shard and slot of the rows of written buckets."""
    n_rows = max(1, buckets.count())
    counts = buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix_sums(counts, "_bucket", "_n", "_start").select("_bucket", "_start")
    # Shard s holds the positions from floor(s * n_rows / n_shards) up to the next shard's.
    return (buckets.join(maybe_broadcast(starts), "_bucket")
                   .withColumn("position", F.col("_start") + F.col("_pos"))
                   .withColumn("shard", F.expr(f"int(((position + 1) * {n_shards} - 1) div {n_rows})"))
                   .withColumn("slot", F.expr(f"position - (bigint(shard) * {n_rows}) div {n_shards}"))
                   .drop("_bucket", "_pos", "_start"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's shard and slot, digested from the written records."""
    placed = external_shuffle(read_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position")
