"""Best-fit packing of token pieces into sequences, by hierarchical residual rounds.

1. Documents become pieces (``token_pieces``): ids plus an end id, cut only
   where longer than ``size``.
2. Every partition packs its pieces best-fit, longest first.  Nearly full bins
   (no room for the partition's shortest piece, or filled to ``full_share``)
   are final at once.
3. Bins with room left become items.  Partitions are merged ``fan`` at a time
   and their items packed best-fit again, until one merge is left.  Of two
   bins that are at most half full one could hold both, so after a round a
   group has at most one such bin; every gain of later rounds puts one of those
   into another bin.  A group therefore passes on that bin and its ``carry``
   emptiest others, and the rest are final: the last merge stays small however
   many pieces there are, and no group can win more than it passes on.

Defined results: a null or empty text is one piece of length 1 (the end id);
repeated rows are packed like any others; an empty table gives an empty
result; ties go to the earlier bin.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import hold, lean
from rollcall.llm.tokens import load, text_groups


def token_pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each whole text and ``end_id``, cut at ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            doc_ids = iter(batch.column(0).to_pylist())
            for group in text_groups(batch.column(1).to_pylist()):
                ids, counts = encoder.encode(group)
                data, at = ids.astype("<u4").tobytes(), 0
                for n in counts.tolist():
                    doc, own = next(doc_ids), data[4 * at:4 * (at + n)] + last
                    at += n
                    for piece, a in enumerate(range(0, n + 1, size)):
                        part = own[4 * a:4 * (a + size)]
                        rows.append((doc, piece, a, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every item (longest first, fullest bin that has room), and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set where by_room[r] is not empty
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            b, room = len(fill), size
            fill.append(0)
        bin_of[item], offset[item] = b, fill[b]
        fill[b] += length
        left = room - length
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bin_of, offset, fill


def _carried(fill: np.ndarray, size: int, shortest: int, full_share: float, carry: int) -> np.ndarray:
    """Bins that go on to the next round: with room for the shortest item, the ``carry`` emptiest."""
    room = size - fill
    open_bins = np.flatnonzero((room >= shortest) & (fill < full_share * size))
    return open_bins[np.argsort(fill[open_bins], kind="stable")[:carry]]


def _pack_local(size: int, full_share: float, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        lengths = rows.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, size)
        base = TaskContext.get().partitionId() << 40
        goes_on = np.zeros(len(fill), bool)
        goes_on[_carried(np.array(fill), size, int(lengths.min()), full_share, carry)] = True
        out = (rows.append_column("bin", pa.array(bins + base)).append_column("at", pa.array(offsets))
               .append_column("fill", pa.array(np.array(fill)[bins])).append_column("open", pa.array(goes_on[bins])))
        yield from out.to_batches(max_chunksize=20_000)

    return run


def _pack_round(size: int, full_share: float, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("bin")
        group = rows.column("group").to_numpy()
        for g in np.unique(group):
            own = rows.filter(pa.array(group == g))
            items, lengths = own.column("bin").to_numpy(), own.column("fill").to_numpy()
            bins, offsets, fill = best_fit(lengths, size)
            first = np.zeros(len(fill), np.int64)
            first[bins[::-1]] = items[::-1]  # a merged bin is called after its first item
            goes_on = np.zeros(len(fill), bool)
            goes_on[_carried(np.array(fill), size, int(lengths.min()), full_share, carry)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(items), pa.array(first[bins]), pa.array(offsets), pa.array(np.array(fill)[bins]),
                 pa.array(goes_on[bins]), pa.array(np.full(len(items), g))],
                names=["bin", "into", "shift", "fill", "open", "group"])

    return run


def pack(pieces: DataFrame, size: int = 2048, per_partition: int = 40_000, fan: int = 8, full_share: float = 1.0,
         carry: int = 256) -> DataFrame:
    """``pieces`` (any columns, ``length``) with ``sequence_id`` and ``offset`` added."""
    # a full piece is a sequence by itself; it is numbered like the bins of the others
    keep = pieces.columns
    n = pieces.filter(F.col("length") < size).count()
    parts = max(1, -(-n // per_partition))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = hold(pieces.filter(F.col("length") < size).repartition(parts).mapInArrow(
        _pack_local(size, full_share, carry), f"{schema}, bin long, at long, fill long, open boolean"), "bins")
    whole = pieces.filter(F.col("length") >= size).select(
        *keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = (placed.filter("open").groupBy("bin").agg(F.max("fill").alias("fill"))
             .withColumn("group", F.shiftright("bin", 40)))
    moves = None
    while parts > 1:
        parts = -(-parts // fan)
        merged = hold(items.withColumn("group", F.floor(F.col("group") / fan).cast("long")).repartition(parts, "group").mapInArrow(
            _pack_round(size, full_share, carry), "bin long, into long, shift long, fill long, open boolean, group long"), "round")
        step = merged.select(F.col("bin").alias("_b"), "into", F.col("shift").alias("_s"))
        if moves is None:
            moves = step.select(F.col("_b").alias("start_bin"), "into", F.col("_s").alias("shift"))
        else:
            moves = hold(moves.withColumnRenamed("into", "_m").join(step, F.col("_m") == F.col("_b"), "left").select(
                "start_bin", F.coalesce("into", "_m").alias("into"),
                (F.col("shift") + F.coalesce("_s", F.lit(0))).alias("shift")), "moves")
        items = merged.filter("open").groupBy(F.col("into").alias("bin")).agg(F.max("fill").alias("fill"), F.max("group").alias("group"))
    if moves is None:
        done = placed.select(*keep, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    else:
        done = placed.join(moves, F.col("bin") == F.col("start_bin"), "left").select(
            *keep, F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return done.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048, **how) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(hold(token_pieces(docs, path, end_id, size), "pieces"), size, **how)
