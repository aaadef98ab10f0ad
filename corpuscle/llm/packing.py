"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids are cut at multiples of the sequence length. Full pieces are sequences of their own where they are cut;
their ids are never shuffled. What is left of each document goes to a random group, and each group is packed by first-fit
decreasing: pieces from long to short, each into the first sequence with room. The group's free room is kept in a
tournament tree (each inner node holds the most room below it), so a piece finds its sequence in logarithmic time.

Groups are dealt out by a seeded hash of id, text and the row's place in its file, so equal rows are spread like others;
a group that still grows past ``GROUP_PIECES`` leftovers is packed in parts of that size, so a task's memory has a bound.
Null texts are empty (the end id alone); null and repeated ids are documents like any other; other columns are not read;
an empty table gives no pieces. A sequence's id is unique: below zero for a full piece, else by group. It stays the same
from run to run over the same files; ``docs`` should be a stored table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, forget

SEQUENCE, END_ID, SEED = 2048, 1, 20
#: Leftovers packed together: enough for a tight fit, and 32 MB of ids at most.
GROUP_PIECES = 4096
#: Pieces that are taken from a batch at a time.
SLICE = 1024
#: Groups that a task packs one after the other, roughly, and tasks at most. A task's Arrow batches grow with its groups.
TASK_GROUPS, TASKS = 1, 100_000
PIECE_TYPE = "doc_id {kind}, start long, length long, doc_tokens long, ids array<int>, ids_crc32 long"


class Tournament:
    """Free room of bins 0, 1, 2, …: the first bin with at least so much room, in logarithmic time."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Puts a piece into the first bin that holds it: the bin and the room that it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        had, leaf = most[at], at
        most[at] = had - size
        while at > 1:
            at >>= 1
            most[at] = max(most[2 * at], most[2 * at + 1])
        return leaf - self.leaves, had


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; equal sizes keep their order."""
    tree, out = Tournament(len(sizes), room), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where, had = tree.take(sizes[k])
        out[k] = (where, room - had)
    return out


def cut(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Pieces of documents: (spread, doc_id, start, length, doc_tokens, ids, ids_crc32); ``spread`` is the document's random number.

    ids_crc32 is null but for full pieces with ``digest``, which have it in place of their ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()

        def sent(rows, ids, batch):
            take, start, length, tokens, sums = (list(c) for c in zip(*rows))
            lengths = [0 if x is None else len(x) // 4 for x in ids]
            cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(x for x in ids if x is not None), dtype="<i4"))
            listed = pa.ListArray.from_arrays(pa.array(cuts), values, mask=pa.array([x is None for x in ids]))
            take = pa.array(take)
            columns = [batch.column(2).take(take), batch.column(0).take(take), *(pa.array(c, pa.int64()) for c in (start, length, tokens)), listed, pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["spread", "doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"])

        for batch in batches:
            rows, ids, held = [], [], 0
            for row, text in enumerate(batch.column(1)):
                data = model.encode(text.as_py()) + end
                n = len(data) // 4
                for start in range(0, n, sequence):
                    size = min(sequence, n - start)
                    piece = data[4 * start : 4 * (start + size)]
                    summed = digest and size == sequence
                    rows.append((row, start, size, n, zlib.crc32(piece) if summed else None))
                    ids.append(None if summed else piece)
                    held += size
                    if held >= 1_000_000:
                        yield sent(rows, ids, batch)
                        rows, ids, held = [], [], 0
            if rows:
                yield sent(rows, ids, batch)

    text = common.text_or_empty(F.col("text"))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(F.lit(seed), F.col("doc_id"), text, place).alias("spread"))
    return rows.mapInArrow(run, f"spread long, {PIECE_TYPE.format(kind=kind)}")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID, seed: int = SEED, groups: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset: one row for each piece.

    ``groups`` defaults to one for each ``GROUP_PIECES`` documents, by the table's row count. With ``digest`` the
    pieces' ids are replaced by their checksums, ids_crc32, in the worker that has them as part of a sequence.
    """
    if groups is None:
        groups = max(1, -(-docs.count() // GROUP_PIECES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    most = GROUP_PIECES
    out = ["doc_id", "start", "length", "doc_tokens", "ids_crc32" if digest else "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded by now
        group, used, held = None, 0, []

        def packed():
            nonlocal used, held
            if held:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                got = first_fit_decreasing(table.column("length").to_pylist(), sequence)
                columns = {c: table.column(c) for c in out if c in table.schema.names}
                if digest:
                    columns["ids_crc32"] = checksums(table.column("ids"))
                columns |= {"sequence_id": pa.array([(group << 36) + used + b for b, _ in got], pa.int64()), "offset": pa.array([o for _, o in got], pa.int64())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in out], out)
                used += max(b for b, _ in got) + 1
                held = []

        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, len(whole), SLICE)):
            full = batch.column("length").to_numpy() == sequence
            if full.any():
                # with ``digest`` only: a sequence already, under the number that it got where it was cut
                alone = batch.filter(pa.array(full))
                numbers = pa.array(-1 - alone.column("number").to_numpy())
                columns = {"sequence_id": numbers, "offset": pa.array(np.zeros(len(alone), np.int64))}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else alone.column(c) for c in out], out)
                batch = batch.filter(pa.array(~full))
            of = batch.column("group").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if of[a] != group:
                    yield from packed()
                    group, used = int(of[a]), 0
                rest = batch.slice(a, b - a)
                while len(rest):
                    free = most - sum(map(len, held))
                    held.append(rest.slice(0, free))
                    rest = rest.slice(free)
                    if sum(map(len, held)) >= most:
                        yield from packed()
        yield from packed()

    pieces = cut(docs, tokenizer_path, sequence, end_id, seed, digest)
    pieces = pieces.withColumn("number", F.monotonically_increasing_id()).withColumn("group", F.pmod("spread", F.lit(groups)))
    schema = f"{PIECE_TYPE.format(kind=kind)}, sequence_id long, offset long".replace(", ids array<int>" if digest else ", ids_crc32 long", "")
    alone = None
    if not digest:
        # both kinds of pieces come from one pass
        pieces = common.stored(pieces, "pieces")
        alone = pieces.where(F.col("length") == sequence).select(*out[:5], (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        pieces = pieces.where(F.col("length") < sequence)
    tasks = max(1, min(TASKS, -(-groups // TASK_GROUPS)))
    dealt = pieces.repartition(tasks, "group").sortWithinPartitions("group", "spread", "start")
    found = dealt.mapInArrow(run, schema)
    return found if alone is None else found.unionByName(alone)


def checksums(ids: pa.ListArray) -> pa.Array:
    """The unsigned CRC-32 of each list's little-endian ids."""
    cuts = ids.offsets.to_numpy()
    data = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
    return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.int64())


def digests(docs: DataFrame, tokenizer_path: str, **parameters) -> DataFrame:
    """The packed pieces of ``docs`` with a checksum in place of their ids."""
    return pack(docs, tokenizer_path, digest=True, **parameters).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
