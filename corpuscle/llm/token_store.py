"""Token-ID output in ORC: integer run-length encoded ids, row indexes, and Bloom filters on document ids.

``write`` encodes whole texts and lays the documents out in ascending id order, one ORC file for each range of ids;
ORC's own writer puts the ids in run-length encoded integer streams, keeps minimum and maximum for each stripe and
row group, and adds a Bloom filter on ``doc_id``. ``read`` opens the files again: stripes are read in parallel, a
filter on ``doc_id`` or ``position`` prunes files, stripes and row groups by their metadata. ``offsets`` turns the
files into the place of each document in the whole token stream.

Null texts are empty (the end id alone). Null ids come first, as Spark sorts them. Repeated ids each keep their own
row, in the order of their texts' hashes. Columns other than the id and the text are not written. An empty table
gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

END_ID = 2
#: Rows of a row group, for each of which the writer keeps statistics and a Bloom filter.
ROW_GROUP = 1000
#: Bytes that a stripe's columns take in memory before it is written.
STRIPE_BYTES = 64 << 20
#: Ids that a batch of the encoder's output holds at most, unless one document alone has more.
BATCH_IDS = 2_000_000


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to (doc_id, ids): the ids of the whole text, then ``end_id``. Keeps the order of rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, got, held, since = batch.column(0), [], 0, 0
            for row, text in enumerate(batch.column(1)):
                got.append(model.encode(text.as_py()) + end)
                held += len(got[-1]) // 4
                if held >= BATCH_IDS or row == len(keys) - 1:
                    lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
                    cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                    ids = pa.array(np.frombuffer(b"".join(got), dtype="<i4"))
                    yield pa.RecordBatch.from_arrays([keys.slice(since, len(got)), pa.ListArray.from_arrays(pa.array(cuts), ids)], ["doc_id", "ids"])
                    got, held, since = [], 0, row + 1

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Writes (position, doc_id, ids) to ORC files; ``position`` ascends with the ids of documents over all files."""
    text = common.text_or_empty(F.col("text"))
    # ranges cut by the text's hash too, so that many rows of one id are several files
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = encode(ordered, tokenizer_path, end_id).select(F.monotonically_increasing_id().alias("position"), "doc_id", "ids")
    (
        rows.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.rows.between.memory.checks", str(ROW_GROUP))
        .option("orc.encoding.strategy", "SPEED")
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``write``: position, doc_id, ids."""
    return spark.read.orc(path)


def offsets(store: DataFrame) -> DataFrame:
    """(position, doc_id, n_tokens, ids_crc32, start): each document's digest and its place in the whole stream.

    Two levels: a running sum inside each file's range of positions, and one over the totals of the ranges, of which
    there are as many as files.
    """
    kind = store.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            cuts = ids.offsets.to_numpy()
            data = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], ["position", "doc_id", "n_tokens", "ids_crc32"])

    rows = store.select("position", "doc_id", "ids").mapInArrow(digest, f"position long, doc_id {kind}, n_tokens long, ids_crc32 long")
    rows = common.stored(rows.withColumn("range", F.shiftright("position", 33)), "token-counts")
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("position")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "range").select("position", "doc_id", "n_tokens", "ids_crc32", (F.col("before") + F.col("inside")).alias("start"))


def digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes a store in the shared folder, reads it back, and returns doc_id, start, n_tokens, ids_crc32."""
    path = common.fresh_dir(spark, "token-store")
    write(docs, path, tokenizer_path, end_id)
    return offsets(read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
