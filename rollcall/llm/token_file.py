"""Token-id files: adaptive context-mixing range coding in independently reset, checksummed blocks.

A file holds *frames*; a frame holds whole documents in ascending order, their
ids cut into blocks of equal length.  Every block starts from a fresh model and
carries its own length and the crc32 of its ids, so blocks decode in any order
and damage is found and confined.

The model of a block predicts the next id three times: order 2 and order 1 by
the id that followed the same context last (hashed slots with a confidence of
0 to 3), order 0 by the id counts of the frame, which its header carries.  How
often a prediction of each confidence has been right adapts within the block;
the predictions are mixed into one distribution (what order 2 leaves goes to
order 1, what both leave to order 0) and an id is one step of a 64-bit range
coder.  All arithmetic is on integers.  Blocks of a frame are coded side by
side, one numpy lane each.

Defined results: null text counts as empty (only the end id); null ids sort
first; rows with equal ids are ordered by a hash of their text; an empty table
gives no frame and an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.llm.tokens import load, text_groups

MAGIC = b"IDC1"
HEAD = "<QQIIII"
FRAME_IDS = 4 << 20
LANES, LEAST_BLOCK, MOST_BLOCK = 2048, 256, 4096
SLOTS1, SLOTS2 = 512, 1024
MIX, ORDER0 = 12, 18  # bits of the mixing weights and of the order-0 counts
U = np.uint64
K1, K2, K3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
S1, S2 = np.uint32(32 - 9), np.uint32(32 - 10)  # for 512 and 1024 slots


class Model:
    """State of all lanes: prediction slots, hit rates, the two latest ids."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int32)
        self.slots1, self.slots2 = np.zeros(lanes * SLOTS1, np.int32), np.zeros(lanes * SLOTS2, np.int32)
        self.base1, self.base2 = lane * SLOTS1, lane * SLOTS2
        # hit rate per confidence, in 1 / 65536; confidence 0 means an empty slot
        self.rate1 = np.tile(np.array([0, 16000, 32000, 48000], np.int32), lanes)
        self.rate2 = np.tile(np.array([0, 24000, 40000, 56000], np.int32), lanes)
        self.rates = lane * 4
        self.last = np.zeros(lanes, np.uint32)
        self.last2 = np.zeros(lanes, np.uint32)

    def predict(self):
        """Predicted ids of order 2 and 1 and their mixing weights (of ``2 ** MIX``)."""
        self.at1 = self.base1 + ((self.last * K1) >> S1).astype(np.int32)
        self.at2 = self.base2 + ((self.last * K2 + self.last2 * K3) >> S2).astype(np.int32)
        self.s1, self.s2 = self.slots1[self.at1], self.slots2[self.at2]
        self.c1, self.c2 = self.s1 & 3, self.s2 & 3
        self.p1, self.p2 = self.s1 >> 2, self.s2 >> 2
        self.r1, self.r2 = self.rates + self.c1, self.rates + self.c2
        self.q1, self.q2 = self.rate1[self.r1], self.rate2[self.r2]
        w2 = self.q2 >> (16 - MIX)
        w1 = (((1 << MIX) - w2) * self.q1) >> 16
        same = (self.p1 == self.p2) & (self.c2 > 0)
        joint = w1 * same
        w2 += joint
        w1 -= joint
        return w2, w1

    def update(self, ids) -> None:
        hit1, hit2 = (self.p1 == ids) & (self.c1 > 0), (self.p2 == ids) & (self.c2 > 0)
        for rate, r, q, c, hit in ((self.rate1, self.r1, self.q1, self.c1, hit1), (self.rate2, self.r2, self.q2, self.c2, hit2)):
            moved = q + ((np.where(hit, 65000, 64) - q) >> 4)
            rate[r] = np.where(c > 0, np.minimum(moved, 62000), 0)
        fresh = (ids << 2) | 1
        self.slots1[self.at1] = np.where(hit1, self.s1 + (self.c1 < 3), np.where(self.c1 > 1, self.s1 - 1, fresh))
        self.slots2[self.at2] = np.where(hit2, self.s2 + (self.c2 < 3), np.where(self.c2 > 1, self.s2 - 1, fresh))
        self.last2, self.last = self.last, ids.astype(np.uint32)


def _normalise(low, span):
    """Lanes that put out their top word, and the spans, cut where the top word was still open."""
    small = span < U(1 << 32)
    split = ((low ^ (low + span - U(1))) >> U(32)) != 0
    return np.flatnonzero(small), np.where(split & small, (~low + U(1)) & U(0xFFFFFFFF), span)


def encode_lanes(grid: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> list[bytes]:
    """Code every row of ``grid`` (lane, step) by itself."""
    lanes, steps = grid.shape
    model = Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, np.iinfo(np.uint64).max, U)
    out, at = np.zeros((lanes, 2 * steps + 4), "<u4"), np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(grid.T.astype(np.int32))
    freq, cum = freq.astype(np.int32), cum.astype(np.int32)
    for ids in columns:
        w2, w1 = model.predict()
        rest = (1 << MIX) - w2 - w1
        by2, by1 = (ids == model.p2) & (w2 > 0), (ids == model.p1) & (w1 > 0)
        first = np.where(by2, 0, np.where(by1, w2 << ORDER0, ((w2 + w1) << ORDER0) + rest * cum[ids]))
        width = np.where(by2, w2 << ORDER0, np.where(by1, w1 << ORDER0, rest * freq[ids]))
        unit = span >> U(MIX + ORDER0)
        low = low + unit * first.astype(U)
        span = unit * width.astype(U)
        done, span = _normalise(low, span)
        out[done, at[done]] = low[done] >> U(32)
        at[done] += 1
        low[done] <<= U(32)
        span[done] <<= U(32)
        model.update(ids)
    rows = np.arange(lanes)
    out[rows, at] = low >> U(32)
    out[rows, at + 1] = low & U(0xFFFFFFFF)
    return [out[i, :n + 2].tobytes() for i, n in enumerate(at.tolist())]


def decode_lanes(parts: list[bytes], steps: int, freq: np.ndarray, cum: np.ndarray, by_slot: np.ndarray) -> np.ndarray:
    lanes = len(parts)
    words = np.zeros((lanes, max(map(len, parts)) // 4 + 2), "<u4")
    for i, p in enumerate(parts):
        words[i, :len(p) // 4] = np.frombuffer(p, "<u4")
    model = Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, np.iinfo(np.uint64).max, U)
    code = (words[:, 0].astype(U) << U(32)) | words[:, 1].astype(U)
    at = np.full(lanes, 2, np.int64)
    grid = np.zeros((steps, lanes), np.int32)
    freq, cum, by_slot = freq.astype(np.int32), cum.astype(np.int32), by_slot.astype(np.int32)
    for step in range(steps):
        w2, w1 = model.predict()
        rest = (1 << MIX) - w2 - w1
        unit = span >> U(MIX + ORDER0)
        target = np.minimum((code - low) // unit, U((1 << (MIX + ORDER0)) - 1)).astype(np.int32)
        edge1 = w2 << ORDER0
        edge0 = (w2 + w1) << ORDER0
        ids = by_slot[np.maximum(target - edge0, 0) // rest]
        by2, by1 = target < edge1, target < edge0
        ids = np.where(by2, model.p2, np.where(by1, model.p1, ids))
        first = np.where(by2, 0, np.where(by1, edge1, edge0 + rest * cum[ids]))
        width = np.where(by2, edge1, np.where(by1, w1 << ORDER0, rest * freq[ids]))
        low = low + unit * first.astype(U)
        span = unit * width.astype(U)
        done, span = _normalise(low, span)
        low[done] <<= U(32)
        span[done] <<= U(32)
        code[done] = (code[done] << U(32)) | words[done, np.minimum(at[done], words.shape[1] - 1)]
        at[done] += 1
        grid[step] = ids
        model.update(ids)
    return grid.T


def _order0(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies (at least 1 where counted, sum ``2 ** ORDER0``), their running sum, and slot -> id."""
    total, goal = int(counts.sum()), 1 << ORDER0
    if np.count_nonzero(counts) > goal:
        raise ValueError("more different ids in a frame than the order-0 table has slots")
    if not total:
        raise ValueError("a frame without ids")
    # one slot for every id that occurs, the others in proportion; what rounding leaves goes to the largest remainders
    share = counts * (goal - np.count_nonzero(counts))
    freq = share // total + (counts > 0)
    left = goal - int(freq.sum())
    freq[np.argsort(-(share % total), kind="stable")[:left]] += 1
    cum = np.cumsum(freq) - freq
    return freq, cum, np.repeat(np.arange(len(freq)), freq)


def encode_frame(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame of whole documents: header, document table, order-0 counts, blocks."""
    steps = int(min(MOST_BLOCK, max(LEAST_BLOCK, -(-len(ids) // LANES))))
    lanes = -(-len(ids) // steps)
    grid = np.full(lanes * steps, ids[-1], np.int64)
    grid[:len(ids)] = ids
    grid = grid.reshape(lanes, steps)
    used, times = np.unique(ids, return_counts=True)
    table = np.zeros(int(used[-1]) + 1, np.int64)
    table[used] = times
    freq, cum, _ = _order0(table)
    docs = zlib.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes()
                         + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(counts, "<u8").tobytes())
    order0 = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + times.astype("<u4").tobytes())
    head = MAGIC + struct.pack(HEAD, len(ids), len(doc_ids), steps, len(used), len(docs), len(order0)) + docs + order0
    out = [head, struct.pack("<I", zlib.crc32(head))]
    for i, part in enumerate(encode_lanes(grid, freq, cum)):
        own = ids[i * steps:(i + 1) * steps].astype("<u4").tobytes()
        block = struct.pack("<III", len(own) // 4, len(part), zlib.crc32(own)) + part
        out += [block, struct.pack("<I", zlib.crc32(block))]
    return b"".join(out)


def decode_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, id counts and ids of a frame; raises ``ValueError`` if a checksum of header, coded bytes or ids fails."""
    at = 4 + struct.calcsize(HEAD)
    if frame[:4] != MAGIC or len(frame) < at:
        raise ValueError("not a token-id frame")
    n, n_docs, steps, n_used, docs_size, order_size = struct.unpack_from(HEAD, frame, 4)
    body = at + docs_size + order_size
    if len(frame) < body + 4 or struct.unpack_from("<I", frame, body)[0] != zlib.crc32(frame[:body]):
        raise ValueError("checksum of the header fails")
    docs = zlib.decompress(frame[at:at + docs_size])
    null = np.frombuffer(docs, np.uint8, n_docs)
    doc_ids = np.frombuffer(docs, "<i8", n_docs, n_docs).tolist()
    counts = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at += docs_size
    order0 = zlib.decompress(frame[at:at + order_size])
    used = np.cumsum(np.frombuffer(order0, "<u4", n_used)).astype(np.int64)
    table = np.zeros(int(used[-1]) + 1, np.int64)
    table[used] = np.frombuffer(order0, "<u4", n_used, 4 * n_used)
    at = body + 4
    parts, heads = [], []
    while at < len(frame):
        size, length, crc = struct.unpack_from("<III", frame, at) if at + 16 <= len(frame) else (0, 0, 0)
        end = at + 12 + length
        if not size or end + 4 > len(frame) or struct.unpack_from("<I", frame, end)[0] != zlib.crc32(frame[at:end]):
            raise ValueError(f"checksum of block {len(parts)} fails")
        parts.append(frame[at + 12:end])
        heads.append((size, crc))
        at = end + 4
    if sum(size for size, _ in heads) != n:
        raise ValueError("blocks are missing")
    ids = decode_lanes(parts, steps, *_order0(table)).reshape(-1)[:n].astype("<u4")
    for i, (size, crc) in enumerate(heads):
        if zlib.crc32(ids[i * steps:i * steps + size].tobytes()) != crc:
            raise ValueError(f"checksum of block {i} fails")
    return [None if z else d for d, z in zip(doc_ids, null)], counts, ids


def write_token_file(docs: DataFrame, folder: str, path: str, end_id: int, frame_ids: int = FRAME_IDS) -> None:
    """Encode all documents in ascending ``doc_id`` and write the frames to ``folder`` (one file per range of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = load(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def frame() -> pa.RecordBatch:
            data = encode_frame(doc_ids, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                (part, pa.int64()), (seq, pa.int64()), (held, pa.int64()), (data, pa.binary()))], names=["part", "seq", "n_ids", "frame"])

        for batch in batches:
            own = iter(batch.column(0).to_pylist())
            for group in text_groups(batch.column(1).to_pylist()):
                found, sizes = encoder.encode(group)
                doc_ids += [next(own) for _ in group]
                ids.append(np.insert(found, np.cumsum(sizes), end_id))
                counts.append(sizes + 1)
                held += len(ids[-1])
                if held >= frame_ids:
                    yield frame()
                    doc_ids, counts, ids, held, seq = [], [], [], 0, seq + 1
        if held:
            yield frame()

    text = F.col("text").cast("string")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
               .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    (ordered.mapInArrow(run, "part long, seq long, n_ids long, frame binary")
     .write.option("compression", "none").parquet(folder))


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the frames in ``folder``."""
    frames = spark.read.parquet(folder)
    sizes = frames.select("part", "seq", "n_ids")
    # frames before it in its file, and files before its file: one row per file in the only window over all
    files = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    files = files.select(F.col("part").alias("_p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    base = sizes.join(files, F.col("part") == F.col("_p")).select(
        F.col("part").alias("_p"), F.col("seq").alias("_s"),
        (F.col("before") + F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, counts, ids = decode_frame(data.as_py())
                stops = np.cumsum(counts)
                raw, edges = ids.tobytes(), (4 * np.concatenate([[0], stops])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + stops - counts), pa.array(counts),
                     pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = frames.join(base, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    return joined.select("base", "frame").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
