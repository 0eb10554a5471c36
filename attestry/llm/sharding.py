"""Contiguous byte-balanced shards from global prefix sums (law ``bytes``).

The corpus is put into one global order (``doc_id``, then checksum, size and scan position) by
a range exchange that carries only these few numbers, never a text.  Each partition's byte total
goes to the driver (a row per partition); their prefix sums tell every partition where it starts,
so one pass gives every document its global byte offset, and offsets are cut at equal targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import durable, table

#: Bytes that every document counts besides its text.
OVERHEAD = 16


def byte_shards(docs: DataFrame, shards: int = 40, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``.

    A document goes to the shard in whose byte range its midpoint falls, so shards are contiguous in
    the global order and differ from the equal target by less than one document at either end.  Nulls: a
    null or empty text has size ``OVERHEAD`` and the checksum of no bytes; very long texts count whole; null ids come first.  Repeated rows and
    ties are kept and ordered by scan position.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("scan_pos", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "text_crc32", "size", "scan_pos"]
    # The range bounds are sampled, so the ordered rows are fixed before anything is counted on them.
    ranged = durable(slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("scan_pos"))
    totals = (
        ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    )  # one row per partition
    starts: dict[int, tuple[int, int]] = {}
    at_byte = at_row = 0
    for r in sorted(totals, key=lambda r: r["pid"]):
        starts[r["pid"]] = (at_byte, at_row)
        at_byte, at_row = at_byte + r["size"], at_row + r["n"]
    total = max(at_byte, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        byte, row = starts.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("size").to_numpy(zero_copy_only=False)
            end = byte + np.cumsum(size)
            # The twice-midpoint times the shard count may pass 2**63 on a very large corpus, so split the division.
            twice = (2 * end - size).tolist()
            shard = np.array([min(x * shards // (2 * total), shards - 1) for x in twice], np.int32)
            rows = row + np.arange(b.num_rows, dtype=np.int64)
            byte, row = int(end[-1]), row + b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(shard), pa.array(rows)],
                names=["doc_id", "size", "text_crc32", "shard", "row"],
            )

    kind = ranged.schema["doc_id"].dataType.simpleString()
    placed = ranged.mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, shard int, row long")
    firsts, at = [0] * shards, 0
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    for s in range(shards):
        firsts[s], at = at, at + counts.get(s, 0)
    first = F.element_at(F.array(*map(F.lit, firsts)), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - first).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
