"""Suffix-array de-duplication: bytes covered by a string of ``length`` bytes that an earlier document has too.

A window is a string of ``length`` bytes.  Every window is *owned* by its
smallest 24-byte gram (by hash, the leftmost of equal ones), so equal windows
have equal owners at equal offsets.

1. Every document is cut into its owning grams, each with a digest of the
   bytes of all windows it owns (its *context*).  A task gathers a million of
   them; equal contexts are folded to the smallest document; the others are
   decided there and then (their lines only pass through step 2).  What is left
   goes to fragments of the gram hashes, one line per fragment and million.
2. Fragments fold the rest: of equal contexts all but the smallest document
   are decided.  Only grams with different contexts, in different documents,
   are left open, and only their distinct contexts.  As a window holds half of
   the bytes beside its gram on one side, contexts are open only where another
   document has the same bytes there (by a digest of one byte for each side).
3. The open contexts are dealt to shards of bounded bytes by gram.  A shard writes its contexts
   one after the other and sorts them with ``induced_sort``; windows with a
   common prefix of ``length`` are equal and take the smallest document among
   them.  A gram with more than ``crowd`` contexts goes to no shard: its windows
   fold inside the task that cuts them, where all but the smallest document are
   decided at once.  What is left is folded to one smallest document per window
   by partial minima and joined back; the windows that many rows still have are
   few and are broadcast, so no task gathers the copies of one window.
4. The decided windows of a document are merged into runs and cut out.

Defined results: a null text counts as empty; matches never cross documents;
a null ``doc_id`` comes after all others, and rows with the same ``doc_id``
are not earlier than each other (such rows are told apart by a digest of their
texts, others by the id); an empty table gives an empty result.  Extra
columns are kept by ``cut_repeats`` and not read by ``repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.spread import shuffle_parts, small
from rollcall.llm.common import hold, input_bytes, lean
from rollcall.llm.induced_sort import suffix_array
from rollcall.llm.ngram_join import BASE, _by, _mixed

U = np.uint64
GRAM = 24
LAST_ID = np.iinfo(np.int64).max


class Rolling:
    """Digests of byte ranges by running polynomial sums."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, U)

    def load(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(self.powers) < n:
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, U)
                steps[0] = U(1)
                setattr(self, name, np.cumprod(steps, dtype=U))
        self.sums = np.zeros(n, U)
        terms = data.astype(U)
        terms += U(1)
        terms *= self.powers[:n - 1]
        np.cumsum(terms, dtype=U, out=self.sums[1:])

    def grams(self) -> np.ndarray:
        """Digests of all grams, by position, worked out in place."""
        h = self.sums[GRAM:] - self.sums[:-GRAM]
        h *= self.inverse[:len(h)]
        h += U(GRAM * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        for factor in (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), None):
            h ^= h >> U(33)
            if factor is not None:
                h *= factor
        return h

    def digest(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start]
                      + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


ROLL = Rolling()


def owners(parts: list[bytes], length: int):
    """Owning grams of concatenated documents: document, position, first and last window (in the document), gram, context digest, and
    one byte each for what lies left and right of the gram (0: its windows do not reach that far on this side)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(U), none.astype(U), none.astype(np.uint8), none.astype(np.uint8)
    ROLL.load(data)
    stops = np.cumsum(sizes)
    gram = ROLL.grams()
    # hash in the upper 40 bits, position below (a run is far below 16 MB): the least is the smallest hash, leftmost first
    assert len(data) < 1 << 24
    key = gram & ~U((1 << 24) - 1)
    key |= np.arange(len(gram), dtype=U)
    width = length - GRAM + 1
    least, have = key, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    inside = np.zeros(len(data) + 1, np.int32)  # windows that end in their document
    long = sizes >= length
    np.add.at(inside, (stops - sizes)[long], 1)
    np.add.at(inside, (stops - length + 1)[long], -1)
    window = np.flatnonzero(np.cumsum(inside)[:len(least)])
    owner = (least[window] & U((1 << 24) - 1)).astype(np.int64)
    if not len(window):
        return none, none, none, none, none.astype(U), none.astype(U), none.astype(np.uint8), none.astype(np.uint8)
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)]))
    tail = np.append(head[1:], len(window)) - 1
    first, last, pos = window[head], window[tail], owner[head]
    doc = np.searchsorted(stops, first, side="right")
    begin = (stops - sizes)[doc]
    # the context also tells where in it the gram lies
    context = _mixed(ROLL.digest(first, last + length) + (pos - first).astype(U) * U(0xA24BAED4963EE407))
    # a window holds, beside its gram, at least half of the other bytes on one side
    side = (length - GRAM) // 2
    ends = []
    for low, reaches in ((pos - side, pos - first >= side), (pos + GRAM, last + length - pos - GRAM >= side)):
        low = np.where(reaches, low, 0)
        ends.append(np.where(reaches, ROLL.digest(low, low + side) % U(255) + U(1), U(0)).astype(np.uint8))
    return doc, pos - begin, first - begin, last - begin, gram[pos], context, *ends


def _pieces(batch: pa.RecordBatch, length: int, most: int = 250_000) -> Iterator[tuple[np.ndarray, int, list[bytes]]]:
    """Runs of (ids and text digests, start in the text, texts) of at most about ``most`` bytes; ids as two int64 columns.

    A longer text stands alone, in pieces that overlap so that every window lies in exactly one; other texts start at 0.
    """
    ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    who = np.stack([ids, batch.column(1).to_numpy(zero_copy_only=False)], 1)
    column = batch.column(2).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    cuts = []
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > most:
            cuts.append((at, i))
            at, held = i, 0
        held += size
    if len(sizes):
        cuts.append((at, len(sizes)))
    for a, b in cuts:
        texts = [t or b"" for t in column.slice(a, b - a).to_pylist()]
        if b - a == 1 and len(texts[0]) > most:
            for start in range(0, len(texts[0]) - length + 1, most):
                yield who[a:b], start, [texts[0][start:start + most + length - 1]]
        else:
            yield who[a:b], 0, texts


PAIR = [("doc", "<i8"), ("hash", "<i8"), ("low", "<u4"), ("high", "<u4")]
OPEN = [("doc", "<i8"), ("hash", "<i8"), ("first", "<u4"), ("last", "<u4"), ("pos", "<u4"), ("gram", "<u8")]
#: Columns of a line of owning grams, one after the other, those of few different bytes by byte planes.
OWN = [("doc", "<u4"), ("pos", "<u4"), ("back", "u1"), ("ahead", "u1"), ("left", "u1"), ("right", "u1"), ("gram", "<u4"), ("context", "<u8")]
PLANES = ("doc", "pos")


def _dealt(gram: np.ndarray, parts: int) -> np.ndarray:
    """Part of each owning gram.  Owners are the least of many hashes, so the hash itself would crowd the first parts."""
    return (_mixed(gram) >> U(40)).astype(np.int64) * parts >> 24


def _ranked(gram: np.ndarray, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by gram, context and document; only grams that come more than once are compared by more than the gram."""
    order = np.argsort(gram)
    ranked = gram[order]
    same = ranked[1:] == ranked[:-1]
    several = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    rows = order[several]
    order[several] = rows[np.lexsort((ids[rows], context[rows], gram[rows]))]
    return order


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, n * np.dtype(kind).itemsize, at)
    return planes.reshape(-1, n).T.copy(order="C").view(kind).ravel()


def _shut(body: bytes) -> bytes:
    """``PAIR`` records for travelling, by byte planes: copies of texts give a run per owning gram, and those should be small."""
    records = np.frombuffer(body, PAIR).copy()
    records["high"] -= records["low"]
    return _planes(records)


def _opened(bodies: list[bytes]) -> np.ndarray:
    dtype = np.dtype(PAIR)
    records = np.concatenate([_unplanes(body, dtype, len(body) // dtype.itemsize, 0) for body in bodies])
    records["high"] += records["low"]
    return records


def _packed(who: np.ndarray, cols: dict[str, np.ndarray]) -> tuple[bytes, bytes]:
    """A line of owning grams: its documents (by differences of their ids), and the columns ``OWN`` with ``doc`` counted in these."""
    mine, local = np.unique(cols["doc"], return_inverse=True)
    who = who[mine]
    cols = cols | {"doc": local}
    body = [cols[name].astype(kind) for name, kind in OWN]
    return (_planes(np.diff(who[:, 0], prepend=np.int64(0))) + _planes(who[:, 1]),
            b"".join(_planes(c) if name in PLANES else c.tobytes() for (name, _), c in zip(OWN, body)))


def _unpacked(lines: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Documents and columns of many lines."""
    whos, cols, docs = [], {name: [] for name, _ in OWN}, 0
    record = sum(np.dtype(kind).itemsize for _, kind in OWN)
    for who, body in lines:
        m, n, at = len(who) // 16, len(body) // record, 0
        whos.append(np.stack([np.cumsum(_unplanes(who, "<i8", m, 0)), _unplanes(who, "<i8", m, 8 * m)], 1))
        for name, kind in OWN:
            cols[name].append(_unplanes(body, kind, n, at) if name in PLANES else np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        cols["doc"][-1] = cols["doc"][-1].astype(np.int64) + docs
        docs += m
    return np.concatenate(whos), {name: np.concatenate(c) for name, c in cols.items()}


def _own(fragments: int, buckets: int, length: int, most: int = 1 << 20):
    """Step 1: lines ``kind 0`` for fragments, ``kind 1`` with windows decided inside the task.

    Lines are made of ``most`` owning grams at a time, so that a line holds many of them however many fragments there are.
    """

    def taken(whos: list[np.ndarray], held: list[tuple]) -> pa.RecordBatch:
        who = np.concatenate(whos)
        cols = {name: np.concatenate(c) for name, c in zip(("doc", "pos", "back", "ahead", "gram", "context", "left", "right"), zip(*held))}
        held.clear()
        whos.clear()
        ids = who[cols["doc"], 0]
        # the order of mixed grams is that of the fragments
        order = _ranked(cols["gram"], cols["context"], ids)
        cols, ids = {name: c[order] for name, c in cols.items()}, ids[order]
        gram, context = cols["gram"], cols["context"]
        same = np.zeros(len(ids), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
        # of equal contexts the smallest document stands for all
        later = ids > ids[lead]
        first = cols["pos"][later].astype(np.int64) - cols["back"][later]
        rows = _decided(who[cols["doc"][later]], first, first + cols["ahead"][later] + length, buckets)
        cols = {name: c[~later] for name, c in cols.items()}
        frag = (cols["gram"] >> U(40)).astype(np.int64) * fragments >> 24
        cols["gram"] = cols["gram"] >> U(8)  # 32 bits beside those that tell the fragment
        cuts = (np.flatnonzero(np.diff(frag)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(frag)]):
            rows.append((0, int(frag[a]), *_packed(who, {name: c[a:b] for name, c in cols.items()})))
        return _lines(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whos, held, docs, n = [], [], 0, 0
        for batch in batches:
            for who, start, parts in _pieces(batch, length):
                doc, pos, first, last, gram, context, left, right = owners(parts, length)
                if not len(doc):
                    continue
                whos.append(who)
                held.append(((doc + docs).astype(np.uint32), (pos + start).astype(np.uint32), (pos - first).astype(np.uint8),
                             (last - first).astype(np.uint8), _mixed(gram), context, left, right))
                docs += len(who)
                n += len(doc)
                if n >= most:
                    yield taken(whos, held)
                    docs = n = 0
        if held:
            yield taken(whos, held)

    return run


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(kind, frag, who, _shut(body) if kind == 1 else body) for kind, frag, who, body in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
        names=["kind", "frag", "who", "body"])


LINE = "kind int, frag int, who binary, body binary"


def _bucketed(records: np.ndarray, buckets: int, kind: int) -> list[tuple]:
    """Records as lines by bucket of their document."""
    # copies of one text have the same hash: they are dealt to at most 16 buckets, so that lines stay few
    doc = _mixed(records["doc"].astype(U))
    name = _mixed(records["hash"].astype(U) ^ doc >> U(60))
    name = np.where(records["hash"] == 0, doc, name)  # rows that are named by their id alone
    bucket = (name >> U(40)).astype(np.int64) * buckets >> 24
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    return [(kind, int(bucket[a]), None, records[a:b].tobytes())
            for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(bucket)]]).tolist()) if b > a]


def _merged(records: np.ndarray) -> np.ndarray:
    """Runs in order of document and start; those that overlap or touch are one."""
    if not len(records):
        return records
    records = records[np.lexsort((records["low"], records["hash"], records["doc"]))]
    group = np.concatenate([[True], (records["doc"][1:] != records["doc"][:-1]) | (records["hash"][1:] != records["hash"][:-1])])
    # running highest end inside a document, to find where a run starts
    lift = np.cumsum(group).astype(np.int64) << 32
    reach = np.maximum.accumulate(records["high"] + lift)
    head = np.flatnonzero(np.concatenate([[True], records["low"][1:] + lift[1:] > reach[:-1]]))
    tail = np.append(head[1:], len(records)) - 1
    merged = records[head].copy()
    merged["high"] = (reach[tail] - lift[tail]).astype(np.uint32)
    return merged


def _runs(who: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    records = np.zeros(len(who), PAIR)
    records["doc"], records["hash"], records["low"], records["high"] = who[:, 0], who[:, 1], low, high
    return _merged(records)


def _decided(who: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> list[tuple]:
    return _bucketed(_runs(who, low, high), buckets, 1)


class Outgoing:
    """Records on their way to the buckets of their documents, gathered so that lines hold many."""

    def __init__(self, buckets: int, most: int = 1 << 19):
        self.buckets, self.most, self.held, self.n = buckets, most, {}, 0

    def add(self, kind: int, records: np.ndarray) -> bool:
        """True if it is time to take the lines."""
        if len(records):
            self.held.setdefault(kind, []).append(records)
            self.n += len(records)
        return self.n >= self.most

    def lines(self) -> pa.RecordBatch:
        rows = []
        for kind, parts in self.held.items():
            records = np.concatenate(parts)
            rows += _bucketed(_merged(records) if kind == 1 else records, self.buckets, kind)
        self.held, self.n = {}, 0
        return _lines(rows)


def _side_met(side: np.ndarray, group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where another document has the same gram with the same bytes on this side."""
    key = group * 256 + side
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    met = np.minimum.reduceat(ids[order], start) != np.maximum.reduceat(ids[order], start)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(met, np.diff(np.append(start, len(key))))
    return out & (side > 0)


def _fold(buckets: int, length: int, crowd: int):
    """Step 2: decided windows (kind 1), open contexts (kind 2) and those of crowded grams (kind 3), by bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outgoing(buckets)
        for frag, lines in _by(batches):
            passed = [body for kind, _, body in lines if kind == 1]
            if passed:
                yield _lines([(1, frag, None, _merged(_opened(passed)).tobytes())])
            lines = [(who, body) for kind, who, body in lines if kind == 0]
            if not lines:
                continue
            who, cols = _unpacked(lines)
            lines.clear()
            order = _ranked(cols["gram"], cols["context"], who[cols["doc"], 0])
            doc, pos, back, ahead, left, right, gram, context = (cols[name][order] for name, _ in OWN)
            ids = who[doc, 0]
            new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
            new_context = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
            lead = np.maximum.accumulate(np.where(new_context, np.arange(len(doc)), 0))
            later = ids > ids[lead]
            first = pos.astype(np.int64) - back
            full = out.add(1, _runs(who[doc[later]], first[later], first[later] + ahead[later] + length))
            # open: grams with several contexts that are not all of one document
            of = np.cumsum(new_gram) - 1
            start = np.flatnonzero(new_gram)
            several = np.add.reduceat(new_context, start)
            differ = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
            ask = np.flatnonzero(((several > 1) & differ)[of] & ~later)
            if len(ask):
                # a window that two contexts share lies half on one side of the gram, and there they are equal
                ask = ask[_side_met(left[ask], of[ask], ids[ask]) | _side_met(right[ask], of[ask], ids[ask])]
                records = np.zeros(len(ask), OPEN)
                records["doc"], records["hash"] = ids[ask], who[doc[ask], 1]
                records["first"], records["last"], records["pos"] = first[ask], first[ask] + ahead[ask], pos[ask]
                records["gram"] = gram[ask].astype(U) | U(frag) << U(32)
                crowded = (np.bincount(of[ask], minlength=1) > crowd)[of[ask]]
                out.add(2, records[~crowded])
                full = out.add(3, records[crowded])
            if full:
                yield out.lines()
        yield out.lines()

    return run


def _gathered(batches: Iterator[pa.RecordBatch], read: Callable[[list[bytes]], np.ndarray]) -> Iterator[np.ndarray]:
    """Records of a partition sorted by bucket, one bucket at a time, from batches of ``frag, body``."""
    group, parts = None, []
    for batch in batches:
        frag = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(frag)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(frag)]) if len(frag) else ():
            if frag[a] != group and parts:
                yield np.concatenate(parts)
                parts = []
            group = frag[a]
            parts.append(read(batch.column(1).slice(a, b - a).to_pylist()))
    if parts:
        yield np.concatenate(parts)


def _per_document(kind: str):
    """Lines of a bucket to one row per document: merged runs, or its open contexts."""
    def read(bodies: list[bytes]) -> np.ndarray:
        return _opened(bodies) if kind == "runs" else np.frombuffer(b"".join(bodies), OPEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in _gathered(batches, read):
            if kind == "runs":
                records = _merged(records)
            else:
                records = np.unique(records)
                records = records[np.lexsort((records["hash"], records["doc"]))]
            change = (records["doc"][1:] != records["doc"][:-1]) | (records["hash"][1:] != records["hash"][:-1])
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(records)]]).tolist()
            for z in range(0, len(cuts) - 1, 20_000):
                part = list(zip(cuts[z:z + 20_000], cuts[z + 1:z + 20_001]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(records["doc"][a]) for a, _ in part], pa.int64()), pa.array([int(records["hash"][a]) for a, _ in part], pa.int64()),
                     pa.array([records[a:b].tobytes() for a, b in part], pa.binary())], names=["_doc", "_hash", "found"])

    return run


HEAD = [("doc", "<i8"), ("hash", "<i8"), ("first", "<u4"), ("size", "<u4")]


def _contexts(shards: int, length: int, most: int = 100_000):
    """Texts of open contexts, dealt to shards by gram: lines of ``HEAD`` records and their bytes, one after the other."""

    def taken(heads: list, where: list, pieces: list) -> pa.RecordBatch:
        head, shard = np.concatenate(heads), np.concatenate(where)
        order = np.argsort(shard, kind="stable")
        head, shard = head[order], shard[order]
        order = order.tolist()
        cuts = (np.flatnonzero(np.diff(shard)) + 1).tolist()
        rows = [(int(shard[a]), head[a:b].tobytes(), b"".join([pieces[i] for i in order[a:b]])) for a, b in zip([0, *cuts], [*cuts, len(order)])]
        for held in (heads, where, pieces):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                                          names=["shard", "head", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, where, pieces = [], [], []
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, (doc, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data, records = texts[i].as_py(), np.frombuffer(batch.column(3)[i].as_py(), OPEN)
                head = np.zeros(len(records), HEAD)
                head["doc"], head["hash"], head["first"] = doc, h, records["first"]
                head["size"] = records["last"] - records["first"] + np.uint32(length)
                heads.append(head)
                where.append(_dealt(records["gram"], shards))
                pieces += [data[a:b] for a, b in zip(records["first"].tolist(), (records["last"].astype(np.int64) + length).tolist())]
                if len(pieces) >= most:
                    yield taken(heads, where, pieces)
        if pieces:
            yield taken(heads, where, pieces)

    return run


WINDOW = "doc long, hash long, low long, high long, piece binary"


def _windows(length: int, most: int = 200_000, chunk: int = 50_000):
    """Windows of crowded grams, folded within the task: decided runs (``piece`` null), and windows not decided yet.

    A window is decided when the task has met it in a smaller document.  What is remembered is cleared above ``most``
    windows, which costs rows, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        out: list[list] = [[] for _ in range(5)]

        def put(*row):
            for col, v in zip(out, row):
                col.append(v)

        def taken() -> pa.RecordBatch:
            ready = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary()))],
                                               names=["doc", "hash", "low", "high", "piece"])
            for col in out:
                col.clear()
            return ready

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in sorted(range(batch.num_rows), key=ids.__getitem__):
                doc, h, data = ids[i], hashes[i], batch.column(2)[i].as_py().encode()
                records = np.frombuffer(batch.column(3)[i].as_py(), OPEN)
                for first, last in zip(records["first"].tolist(), records["last"].tolist()):
                    begun = None
                    for w in range(first, last + 1):
                        piece = data[w:w + length]
                        known = least.get(piece)
                        if known is not None and known < doc:
                            begun = w if begun is None else begun
                            continue
                        if begun is not None:
                            put(doc, h, begun, w - 1 + length, None)
                            begun = None
                        put(doc, h, w, w + length, piece)
                        if len(least) >= most:
                            least.clear()
                        least[piece] = doc
                    if begun is not None:
                        put(doc, h, begun, last + length, None)
                    if len(out[0]) >= chunk:
                        yield taken()
        yield taken()

    return run


def _as_lines(buckets: int):
    """Decided runs (``doc, hash, low, high``) as lines by bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, low, high = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield _lines(_decided(np.stack([doc, h], 1), low, high, buckets))

    return run


def _decide_crowded(windows: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Lines of all decided windows of crowded grams, from ``_windows``."""
    left = windows.filter("piece is not null")
    # partial minima inside the tasks; only windows of different documents decide anything
    least = left.groupBy("piece").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
    least = hold(least.filter("least < most").select(F.col("piece").alias("_piece"), "least", "n"), "least", tidy=True)
    # at most (rows / hot) windows have more than ``hot`` rows: they are broadcast where that is proven small, the rest is shuffled
    same = (F.col("piece") == F.col("_piece")) & (F.col("doc") > F.col("least"))
    many = small(least.filter(F.col("n") > hot).select("_piece", "least"))
    few = least.filter(F.col("n") <= hot).select("_piece", "least")
    cold = left.join(many, F.col("piece") == F.col("_piece"), "left_anti")
    decided = windows.filter("piece is null").select("doc", "hash", "low", "high").unionByName(
        left.join(many, same).select("doc", "hash", "low", "high")).unionByName(
        cold.join(few, same).select("doc", "hash", "low", "high"))
    return decided.mapInArrow(_as_lines(buckets), LINE)


def _sort_shard(length: int, buckets: int, memory: int):
    """Step 3: decided windows of a shard from the suffix and common-prefix arrays of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outgoing(buckets)
        for _, lines in _by(batches):
            head = np.concatenate([np.frombuffer(x[0], HEAD) for x in lines])
            raw = np.frombuffer(b"".join([x[1] for x in lines]), np.uint8)
            lines.clear()
            sizes = head["size"].astype(np.int64)
            line = np.repeat(np.arange(len(head)), sizes)
            text = np.ones(len(raw) + len(head) + 1, np.uint16)  # a 1 behind every context
            text[np.arange(len(raw)) + line] = raw
            text[np.arange(len(raw)) + line] += np.uint16(2)
            text[-1] = 0
            order, common = suffix_array(text, length, memory)
            group = np.cumsum(common < length)
            line = np.repeat(np.arange(len(head) + 1), np.append(sizes + 1, 1))[order]
            begin = np.append(np.cumsum(sizes + 1) - sizes - 1, len(text) - 1)
            at = order - begin[line]
            whole = at + length <= np.append(sizes, 0)[line]
            line, at, group = line[whole], at[whole], group[whole]
            if not len(line):
                continue
            start = np.flatnonzero(np.diff(group, prepend=-1))
            ids = head["doc"][line]
            least = np.minimum.reduceat(ids, start)
            later = ids > np.repeat(least, np.diff(np.append(start, len(ids))))
            line, low = line[later], head["first"][line[later]] + at[later]
            if out.add(1, _runs(np.stack([head["doc"][line], head["hash"][line]], 1), low, low + length)):
                yield out.lines()
        yield out.lines()

    return run


def find_repeats(source: DataFrame, length: int = 50, crowd: int = 16_384, bytes_per_fragment: int = 8 << 20,
                 memory: int = 128 << 20, size_hint: int | None = None, hot: int = 10_000, bytes_per_shard: int = 2 << 20) -> DataFrame:
    """Per document with repeats (``_doc``, ``_hash``): ``found``, its merged runs, from ``source`` (``doc``, ``hash``, ``text``)."""
    spark = source.sparkSession
    n = max(2 * shuffle_parts(spark), (size_hint or input_bytes(source)) // bytes_per_fragment)
    lines = source.mapInArrow(lean(_own(n, n, length)), LINE)
    folded = hold(lines.repartition("frag").sortWithinPartitions("frag").select("frag", "kind", "who", "body").mapInArrow(
        lean(_fold(n, length, crowd)), LINE), "folded", tidy=True)
    left = {r["kind"]: r["n"] for r in folded.groupBy("kind").agg(F.sum(F.length("body")).alias("n")).collect()}
    # what is left open, with all windows of its grams at most
    shards = max(shuffle_parts(spark), left.get(2, 0) // np.dtype(OPEN).itemsize * (2 * length - GRAM) // bytes_per_shard)

    def contexts(kind: int) -> DataFrame:
        asked = (folded.filter(F.col("kind") == kind).select("frag", "body").repartition("frag").sortWithinPartitions("frag")
                 .mapInArrow(lean(_per_document("open")), "_doc long, _hash long, found binary"))
        return source.filter("text is not null").join(asked, (F.col("doc") == F.col("_doc")) & (F.col("hash") == F.col("_hash"))).select(
            "doc", "hash", "text", "found")

    sorted_ = hold(contexts(2).mapInArrow(
        lean(_contexts(shards, length)), "shard int, head binary, body binary")
        .repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_sort_shard(length, n, memory)), LINE), "decided", tidy=True)
    if left.get(3):
        windows = hold(contexts(3).mapInArrow(lean(_windows(length)), WINDOW), "windows", tidy=True)
        sorted_ = sorted_.unionByName(hold(_decide_crowded(windows, n, hot), "decided", tidy=True))
    runs = folded.filter("kind = 1").select("kind", "frag", "body").unionByName(sorted_.select("kind", "frag", "body"))
    return (runs.select("frag", "body").repartition("frag").sortWithinPartitions("frag")
            .mapInArrow(lean(_per_document("runs")), "_doc long, _hash long, found binary"))


def _with_runs(docs: DataFrame, length: int, **how) -> DataFrame:
    """``docs`` with ``__cut_runs`` (null: nothing repeated)."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    # the id tells rows apart unless it comes twice; then the text does
    twice = docs.groupBy(doc.alias("doc")).count().filter("count > 1").limit(1).count()
    name = F.xxhash64(text) if twice else F.lit(0).cast("long")
    marked = docs.withColumns({"__cut_doc": doc, "__cut_hash": name})
    source = docs.select(doc.alias("doc"), name.alias("hash"), text.alias("text"))
    found = find_repeats(source, length, size_hint=input_bytes(docs), **how).select(
        F.col("_doc").alias("__run_doc"), F.col("_hash").alias("__run_hash"), F.col("found").alias("__cut_runs"))
    same = (F.col("__cut_doc") == F.col("__run_doc")) & (F.col("__cut_hash") == F.col("__run_hash"))
    return marked.join(found, same, "left").drop("__cut_doc", "__cut_hash", "__run_doc", "__run_hash")


def _cut(data: bytes, found: bytes | None) -> tuple[bytes, int]:
    if found is None:
        return data, 0
    runs = np.frombuffer(found, PAIR)
    out, at = [], 0
    for low, high in zip(runs["low"].tolist(), runs["high"].tolist()):
        out.append(data[at:low])
        at = high
    out.append(data[at:])
    return b"".join(out), len(runs)


def repeats(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                kept, spans = _cut(data, found)
                for col, v in zip(cols, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length, **how)
    return rows.select("doc_id", "text", "__cut_runs").mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@F.pandas_udf(T.StringType())
def _cut_text(texts: pd.Series, found: pd.Series) -> pd.Series:
    # a run may end inside a character; what is left of it is no text and goes too
    return pd.Series([t if f is None or t is None else _cut(t.encode(), f)[0].decode("utf-8", "ignore") for t, f in zip(texts, found)])


def cut_repeats(docs: DataFrame, length: int = 50, **how) -> DataFrame:
    """``docs``, all rows and columns, with repeated bytes taken out of ``text``."""
    rows = _with_runs(docs, length, **how)
    return rows.select(*[_cut_text(F.col("text").cast("string"), F.col("__cut_runs")).alias("text") if c == "text" else F.col(f"`{c}`")
                         for c in docs.columns])
