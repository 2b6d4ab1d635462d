"""Token ids on disk: frequency-ranked ids in byte-aligned variable-length coding.

A store is a folder with two Parquet tables, written by Spark's committer so that a lost executor leaves no part:

* ``ranks``: rank, token_id, n. The commonest id has rank 0; equal counts are ranked by id.
* ``blocks``: shard, block (both in ascending doc_id order), first_token (tokens of the shard before the block),
  doc_ids, n_tokens, and the block's ranks in two streams: ``control`` holds four two-bit lengths a byte, ``data`` the
  low bytes of each rank, 1 to 4 of them. A block is decoded with a table of the lengths by control byte.

Edge cases: null and empty texts have only the end id; rows without doc_id come first; rows of one doc_id are ordered
by their ids; every input row is stored once. No documents give an empty store. Columns besides are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_path, vocabulary
from .common import materialize, new_path, small_batches

#: About so many tokens make a block; a document is never divided.
BLOCK_TOKENS = 1 << 18

LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_CODED = "doc_id long, n_tokens long, ids binary, token array<int>, n array<long>"
_BLOCKS = "shard int, block int, first_token long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"


def _encoded(docs: DataFrame, text_col: str, end_id: int | None, path: str) -> DataFrame:
    """A row per document with its packed ids, and a row per task with its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, squeeze = vocabulary(path), zstandard.ZstdCompressor(level=3)
        size = max(bpe.size, (end_id or 0) + 1)
        kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        counts = np.zeros(size, dtype=np.int64)
        names = ["doc_id", "n_tokens", "ids", "token", "n"]
        for batch in batches:
            lengths, packed = [], []
            for text in batch.column(text_col).to_pylist():
                ids = np.concatenate([bpe.encode(text or ""), end])
                counts += np.bincount(ids, minlength=size)
                lengths.append(len(ids))
                packed.append(squeeze.compress(ids.astype(kind).tobytes()))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))], names=names)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([counts[seen].tolist()], pa.list_(pa.int64()))], names=names)

    return docs.select("doc_id", text_col).mapInArrow(run, _CODED)


def write(docs: DataFrame, store: str, text_col: str = "text", end_id: int | None = 2, path: str | None = None, shards: int | None = None) -> None:
    """Encodes whole texts, appends ``end_id`` to each, and writes the store in ascending doc_id order."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = materialize(_encoded(docs, text_col, end_id, path), "token-ids")
    counted = coded.filter(F.col("ids").isNull()).select(F.explode(F.arrays_zip("token", "n")).alias("x")).groupBy(F.col("x.token").alias("token_id")).agg(F.sum("x.n").alias("n")).collect()  # a row per id of the vocabulary at most
    order = sorted(((r["n"], r["token_id"]) for r in counted), key=lambda x: (-x[0], x[1]))
    spark.createDataFrame([(rank, token, n) for rank, (n, token) in enumerate(order)], "rank int, token_id int, n long").coalesce(1).write.parquet(f"{store}/ranks")
    rank = np.zeros(max((t for _, t in order), default=0) + 1, dtype=np.uint32)
    for k, (_, token) in enumerate(order):
        rank[token] = k

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bpe, expand = vocabulary(path), zstandard.ZstdDecompressor()
        kind = np.dtype("<u2") if max(bpe.size, (end_id or 0) + 1) <= 1 << 16 else np.dtype("<u4")
        shard, number, before = 0, 0, 0
        docs_in: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, docs_in, parts, held
            control, data = pack(rank[np.concatenate(parts)])
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([docs_in], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["shard", "block", "first_token", "doc_ids", "n_tokens", "control", "data"],
            )
            number, before, docs_in, parts, held = number + 1, before + held, [], [], 0
            return out

        for batch in batches:
            for doc, ids, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                shard = own
                x = np.frombuffer(expand.decompress(ids), dtype=kind)
                docs_in.append(doc)
                parts.append(x)
                held += len(x)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if parts:
            yield flush()

    # A hot doc_id would be one document's rows; ranges are set from a sample of the ids.
    ordered = coded.filter(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(blocks, _BLOCKS).write.option("compression", "zstd").parquet(f"{store}/blocks")


def read(spark: SparkSession, store: str) -> DataFrame:
    """Each document of a store: doc_id, start (tokens of all documents before it), n_tokens, raw (ids as little-endian
    unsigned 32-bit numbers)."""
    small_batches(spark)
    by_rank = spark.read.parquet(f"{store}/ranks").select("rank", "token_id").collect()  # the vocabulary at most
    token = np.zeros(len(by_rank) or 1, dtype="<u4")
    for r in by_rank:
        token[r["rank"]] = r["token_id"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{store}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["n_tokens"], dtype=np.int64)
                ids = token[unpack(r["control"], r["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["first_token"] + r["before"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "raw"],
                )

    # One row per shard, so at most as many as write() was given.
    return blocks.join(F.broadcast(before), "shard").mapInArrow(run, T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("raw", "binary"))


def new_store(spark: SparkSession) -> str:
    return new_path(spark, "token-store")
