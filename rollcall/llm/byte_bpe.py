"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries of the pre-tokens are found without a regular expression: an array
of code points is turned into an array of symbol classes by one table look-up
(the few cases that need the next one to three characters are separate
classes), every class is a transition function on eight states, and functions
compose associatively.  The functions that can arise form a small monoid,
worked out from the generators; a scan over blocks composes element numbers by
table look-up and so gives the state before every character, and with it the
boundaries.  Slices go through a cache; a slice not in it is merged by rank.

Defined results: a null text counts as empty and gives no ids; any text
decodes to its own UTF-8 bytes; strings of special tokens are ordinary text;
rows are independent, so ties and repeats need no rule.  Extra columns are
passed through by ``encode_column``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# symbol classes
LETTER, NUMBER, OTHER, MARK1, MARK2, JOIN, SPACE, LAST = range(8)
# states: what the next character may continue
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_JOIN, NEED1, NEED2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this character."""
    if state == NEED2:
        return NEED1, False
    if state == NEED1:
        return FRESH, False
    if symbol == JOIN:
        return AFTER_JOIN, True
    if symbol == LAST:
        return FRESH, True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHER)
    if state in (run, AFTER_JOIN):
        return run, False
    if symbol == MARK1:
        return NEED1, True
    if symbol == MARK2:
        return NEED2, True
    return run, True


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generators, composition table and state-of-FRESH per monoid element, and the start table (state, symbol)."""
    gens = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    number = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in gens:
            h = tuple(g[q] for q in f)  # first f, then g
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    compose = np.array([[number[tuple(g[q] for q in f)] for g in queue] for f in queue], dtype=np.uint16)
    starts = np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])
    return (np.array([number[g] for g in gens], dtype=np.uint16), compose,
            np.array([f[FRESH] for f in queue], dtype=np.uint8), starts)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, before the look-ahead cases."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # white space as the pattern's \s has it
    for low, high in ((9, 13), (32, 32), (133, 133), (160, 160), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                      (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[low:high + 1] = SPACE
    return table


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol classes of concatenated texts; ``ends`` marks the last character of each text."""
    kind = _classes()[points]
    following = np.empty_like(kind)
    following[:-1] = kind[1:]
    following[-1:] = SPACE
    following[ends] = SPACE  # as white space: no token may be joined across texts
    space = kind == SPACE
    last = space & (following != SPACE)
    out = kind.copy()
    out[last] = np.where(points[last] == 32, JOIN, LAST)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        room = np.searchsorted(ends, marks)
        left = ends[room] - marks
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = pad[marks + 1], pad[marks + 2]
        one = (left >= 1) & np.isin(a, [ord(c) for c in "stmd"])
        two = (left >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                             | ((a == ord("l")) & (b == ord("l"))))
        out[marks[one]] = MARK1
        out[marks[two]] = MARK2
    return out


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan under composition: blocks in step, then the block totals by the same scan."""
    n, width = len(functions), 32
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], functions[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), dtype=functions.dtype)  # column = block; element 0 is the identity
    padded = np.zeros(rows * width, dtype=functions.dtype)
    padded[:n] = functions
    grid[:] = padded.reshape(rows, width).T
    flat, size = compose.reshape(-1), compose.shape[0]
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * size + grid[i]]
    before = np.zeros(rows, dtype=np.int32)
    before[1:] = _scan(grid[-1].copy(), compose)[:-1]
    for i in range(width):
        grid[i] = flat[before * size + grid[i]]
    return grid.T.reshape(-1)[:n]


def starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start, in concatenated texts of the given lengths."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    gens, compose, of_fresh, start_table = _machine()
    stops = np.cumsum(lengths)
    ends = np.unique(stops[lengths > 0]) - 1
    kind = symbols(points, ends)
    states = of_fresh[_scan(gens[kind], compose)]
    before = np.empty_like(states)
    before[0] = FRESH
    before[1:] = states[:-1]
    begin = start_table[before, kind]
    # a text always starts a token; what it leaves in its last state is undone by the classes at its start
    heads = np.concatenate([[0], ends[:-1] + 1])
    dirty = heads[~np.isin(before[heads], (FRESH,))]
    if len(dirty):
        _restart(kind, before, begin, dirty, start_table)
    begin[heads] = True
    return np.flatnonzero(begin)


def _restart(kind, before, begin, heads, start_table) -> None:
    """Replay from each text start until the state agrees with the scan."""
    step = [[_step(q, s)[0] for s in range(8)] for q in range(8)]
    n = len(kind)
    for at in heads.tolist():
        state = FRESH
        while at < n and before[at] != state:
            before[at] = state
            begin[at] = start_table[state, kind[at]]
            state = step[state][kind[at]]
            at += 1


class ByteBPE:
    """Ranks of a ``.tiktoken`` file (id = rank) with a slice cache of bounded size."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.most = cache
        self.cache: dict[bytes, tuple[int, ...]] = {}
        size = max(self.ranks.values()) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for t, i in self.ranks.items():
            lengths[i] = len(t)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        pool = bytearray(int(self.offsets[-1]))
        for t, i in self.ranks.items():
            pool[self.offsets[i]:self.offsets[i + 1]] = t
        self.pool = np.frombuffer(bytes(pool), dtype=np.uint8)
        self.lengths = lengths

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the pair of lowest rank is joined first, leftmost on ties."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 512:
            return self._merge_long(piece)
        ranks, parts = self.ranks, [piece[i:i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair:
            least = min(pair)
            if least == none:
                break
            i = pair.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for very long pre-tokens."""
        import heapq
        ranks, n = self.ranks, len(piece)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[i]:
                continue
            alive[j] = False
            end[i], nxt[i] = end[j], nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i:end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            p = prv[i]
            if p >= 0 and (r := ranks.get(piece[p:end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = nxt[i]
        return tuple(out)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as unsigned 32-bit arrays."""
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        cuts = starts(points, lengths)
        data = joined.encode()
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        bounds = byte_at[np.append(cuts, len(points))].tolist()
        pieces = list(map(data.__getitem__, map(slice, bounds, bounds[1:])))
        cache = self.cache
        ids = list(map(cache.get, pieces))
        if None in ids:
            for i, got in enumerate(ids):
                if got is None:
                    piece = pieces[i]
                    got = cache.get(piece)
                    if got is None:
                        got = self.merge(piece)
                        if len(piece) <= 64:
                            if len(cache) >= self.most:
                                cache.clear()
                            cache[piece] = got
                    ids[i] = got
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum()))
        at = np.concatenate([[0], np.cumsum(counts)])
        stops = at[np.searchsorted(cuts, np.cumsum(lengths))]
        return np.split(flat, stops[:-1])

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of an id array, and the byte offset of every id (and the end)."""
        size = self.lengths[ids]
        offsets = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(self.offsets[ids] - offsets[:-1], size)
        return self.pool[shift + np.arange(offsets[-1])].tobytes(), offsets


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_column(docs: DataFrame, path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """``docs`` with ``ids`` (array of long) added; for consumers that want the ids themselves."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def encode(texts: pd.Series) -> pd.Series:
        model = load(path)
        return pd.Series([i.astype("int64") for group in _groups(texts.tolist(), batch_chars)
                          for i in model.encode_texts(group)])

    return docs.withColumn("ids", encode(F.col("text").cast("string")))


def _groups(texts: list, most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a longer text stands alone."""
    group, held = [], 0
    for t in texts:
        t = t or ""
        if group and held + len(t) > most:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def round_trip(docs: DataFrame, path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: encoded, then decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for group in _groups(batch.column(1).to_pylist(), batch_chars):
                ids = model.encode_texts(group)
                flat = np.concatenate(ids)
                data, offsets = model.decode_all(flat)
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                stops = offsets[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                for one, a, b in zip(ids, stops, stops[1:]):
                    n_tokens.append(len(one))
                    ids_sha.append(hashlib.sha256(one.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(data[a:b]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
