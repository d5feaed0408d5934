"""N-gram Jaccard self-join by vertical partitioning.

The set of a text are its distinct word n-grams, as 64-bit hashes.  Equal sets
(by a 128-bit digest) are one *class*.

1. The order of the n-grams (their hash order) is cut into fragments.  A
   fragment holds its part of every class's set, counts in how many classes
   each n-gram occurs, and drops those that occur in one (they cannot be
   shared; only their number matters).
2. The parts of a class meet again.  Of a set of size L at least
   ceil(t * L) must be shared, so two linked classes share one of the
   L - ceil(t * L) + 1 rarest n-grams of either (n-grams of one class come
   first in that order); classes whose rarest are all their own are done.
3. Candidates share one of these n-grams and have fitting sizes.  Lists of at
   most ``short_list`` classes give pairs.  Members of longer lists are joined
   into candidate groups, dealt into blocks of about ``block`` classes by size
   class and hash, and two blocks at a time are compared inside a task by
   matrix products; only links that join two components are put out, so no
   group ever emits its pairs.
4. Candidate pairs are verified by fragment: partial overlaps are counted per
   (pair, fragment) and summed per pair.

Defined results: a null or empty text, or one without words, has an empty set,
size 0, and is linked with nothing; with fewer than n words the whole sequence
is the only n-gram; repeated rows belong to one class; an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.spread import shuffle_parts
from rollcall.llm.common import ASCII_LOWER, hold, input_bytes, lean
from rollcall.llm.components import components

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class WordHasher:
    """Hashes of all words of concatenated bytes by running polynomial sums."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("powers", BASE), ("inverse", inverse)):
                steps = np.full(n, base, U)
                steps[0] = U(1)
                setattr(self, name, np.cumprod(steps, dtype=U))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every word of ``data`` (runs of non-white bytes)."""
        b = np.frombuffer(data, np.uint8)
        dark = ~SPACES[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], dark, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        self._grow(len(b) + 1)
        run = np.zeros(len(b) + 1, U)
        terms = b.astype(U)
        terms += U(1)
        terms *= self.powers[:len(b)]
        np.cumsum(terms, dtype=U, out=run[1:])
        del terms
        h = (run[end] - run[start]) * self.inverse[start]
        return start, _mixed(h ^ (end - start).astype(U) * U(0xD6E8FEB86659FD93))


HASHER = WordHasher()


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text (null as empty), A-Z lower-cased."""
    parts = [(t or b"").translate(ASCII_LOWER) for t in texts]
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    start, word = HASHER.words(b" ".join([*parts, b""]))
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    gram = np.zeros(len(word), U)
    whole = max(0, len(word) - n + 1)  # a run may hold fewer words than one n-gram
    with np.errstate(over="ignore"):
        for k in range(n):
            gram[:whole] = _mixed(gram[:whole] * U(0x9FB21C651E98DF25) + word[k:whole + k] + U(k))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(gram[a:b - n + 1]))
        elif b > a:
            h = U(b - a) * np.ones(1, U)
            for w in word[a:b]:
                h = _mixed(h * U(0x9FB21C651E98DF25) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def _runs(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if i > at and held + size > most:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def _keyed(texts: list, n: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """Digest (null for an empty set) and set of every text."""
    for a, b in _runs(texts):
        for s in shingle_sets(texts[a:b], n):
            yield (hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None), s


def _rows(n: int):
    """One line per document: id, hash of its text, size of its set, key of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), key) for key, s in _keyed(batch.column(2).cast(pa.binary()).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "text_hash", "n_shingles", "key"])

    return run


def _cut_sets(n: int, fragments: int):
    """The sets of classes new to the task, cut into fragments (one line per run of classes and fragment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        fresh: list[tuple[bytes, np.ndarray]] = []
        held = 0
        for batch in batches:
            for key, s in _keyed(batch.column(0).cast(pa.binary()).to_pylist(), n):
                if key is None or key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                fresh.append((key, s))
                held += len(s)
                if held > 1_000_000 or len(fresh) >= 60_000:
                    yield _fragments(fresh, fragments)
                    fresh, held = [], 0
        if fresh:
            yield _fragments(fresh, fragments)

    return run


def _fragments(sets: list[tuple[bytes, np.ndarray]], fragments: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for _, s in sets], "<u4")
    hashes = np.concatenate([s for _, s in sets])
    index = np.repeat(np.arange(len(sets), dtype="<u2"), sizes)
    frag = ((hashes >> U(40)).astype(np.int64) * fragments) >> 24
    order = np.argsort(frag, kind="stable")
    hashes, index, frag = hashes[order], index[order], frag[order]
    cuts = np.flatnonzero(np.diff(frag)) + 1
    a, b = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(frag)]])
    rows = []
    keys = np.frombuffer(b"".join(k for k, _ in sets), np.dtype("V16"))
    for x, y in zip(a.tolist(), b.tolist()):
        own, local = np.unique(index[x:y], return_inverse=True)
        rows.append((int(frag[x]), keys[own].tobytes(), sizes[own].tobytes(), local.astype("<u2").tobytes(), hashes[x:y].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)]],
        names=["frag", "keys", "sizes", "index", "hashes"])


def _by(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Lines of a partition sorted by the first column, one group at a time."""
    group, rows = None, []
    for batch in batches:
        # one line at a time: lines may be large, and a second copy of the batch is not wanted
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != group:
                if rows:
                    yield group, rows
                group, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield group, rows


def _stacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct class keys, their sizes, class number per n-gram, and the n-gram columns."""
    keys, sizes, index, at = [], [], [], 0
    for r in rows:
        keys.append(np.frombuffer(r[0], "V16"))
        sizes.append(np.frombuffer(r[1], "<u4"))
        index.append(np.frombuffer(r[2], "<u2").astype(np.int64) + at)
        at += len(keys[-1])
    every = np.concatenate(keys)
    number: dict[bytes, int] = {}
    local = np.fromiter((number.setdefault(k, len(number)) for k in map(bytes, every)), np.int64, len(every))
    size = np.zeros(len(number), np.int64)
    size[local] = np.concatenate(sizes)
    own = np.frombuffer(b"".join(number), "V16")
    return own, size, local[np.concatenate(index)], [np.frombuffer(b"".join(r[i] for r in rows), "<u8" if i == 3 else "<u4") for i in range(3, len(rows[0]))]


def _shared(grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, class, number of classes) of the n-grams that at least two classes have."""
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    once = np.ones(len(grams), bool)
    once[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[once], owner[once]
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    counts = np.diff(np.append(head, len(grams)))
    df = np.repeat(counts, counts)
    return grams[df > 1], owner[df > 1], df[df > 1]


def _count_fragment(buckets: int):
    """Class counts per n-gram of a fragment; what at least two classes share goes on, by bucket of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frag, rows in _by(batches):
            keys, sizes, owner, (grams,) = _stacked(rows)
            del rows
            # a few bits at a time, so that sorting needs little beside the fragment itself
            part = (grams >> U(20)).astype(np.uint8) & 7
            shared = [_shared(grams[part == i], owner[part == i]) for i in range(8)]
            grams, owner, df = (np.concatenate(c) for c in zip(*shared))
            if not len(grams):
                continue
            bucket = (np.frombuffer(keys.tobytes(), "<u4").reshape(-1, 4)[:, 0].astype(np.int64) * buckets) >> 32
            order = np.lexsort((owner, bucket[owner]))
            grams, owner, df = grams[order], owner[order], df[order]
            of = bucket[owner]
            cuts = np.flatnonzero(np.diff(of)) + 1
            rows = []
            for x, y in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(of)]]).tolist()):
                for z in range(x, y, 60_000):
                    w = min(y, z + 60_000)
                    mine, local = np.unique(owner[z:w], return_inverse=True)
                    rows.append((int(of[x]), keys[mine].tobytes(), sizes[mine].astype("<u4").tobytes(), local.astype("<u2").tobytes(),
                                 grams[z:w].tobytes(), df[z:w].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]],
                names=["bucket", "keys", "sizes", "index", "hashes", "df"])

    return run


def _prefixes(percent: int):
    """Classes that can have partners: their shared n-grams, and which of them lie in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(batches):
            keys, sizes, owner, (grams, df) = _stacked(rows)
            order = np.lexsort((grams, df, owner))
            grams, owner = grams[order], owner[order]
            counts = np.bincount(owner, minlength=len(keys))
            need = sizes - (percent * sizes + 99) // 100 + 1 - (sizes - counts)
            at = np.cumsum(counts) - counts
            out = [(keys[i].tobytes(), int(sizes[i]), grams[at[i]:at[i] + counts[i]].astype("<i8"), int(need[i]))
                   for i in np.flatnonzero(need > 0)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.int32())],
                    names=["key", "size", "grams", "prefix"])

    return run


def _compare_blocks(percent: int, chunk: int = 4096):
    """Links between (and within) two blocks of classes: at most one per joined component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(batches):
            rows = list({r[0]: r for r in rows}.values())
            size = np.array([r[1] for r in rows])
            grams = np.concatenate([np.asarray(r[2], np.int64) for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
            _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
            shared = times[column] > 1
            column, owner = column[shared], owner[shared]
            _, column = np.unique(column, return_inverse=True)
            overlap = np.zeros((len(rows), len(rows)), np.float32)
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
                a, b = np.searchsorted(column, [low, low + chunk])
                dense = np.zeros((len(rows), chunk), np.float32)
                dense[owner[a:b], column[a:b] - low] = 1
                overlap += dense @ dense.T
            both = np.rint(overlap).astype(np.int64)
            union = size[:, None] + size[None, :] - both
            x, y = np.nonzero(np.triu(100 * both >= percent * union, 1))
            root = list(range(len(rows)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            out = []
            for i, j in zip(x.tolist(), y.tolist()):
                a, b = find(i), find(j)
                if a != b:
                    root[a] = b
                    out.append((rows[i][0], rows[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def link_classes(fragments: DataFrame, n_fragments: int, percent: int, short_list: int, block: int) -> DataFrame:
    """Links ``a, b`` between class keys; enough of them to give every component, and no false one."""
    counted = (fragments.repartition("frag").sortWithinPartitions("frag")
               .select("frag", "keys", "sizes", "index", "hashes").mapInArrow(
        lean(_count_fragment(n_fragments)), "bucket int, keys binary, sizes binary, index binary, hashes binary, df binary"))
    classes = hold(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lean(_prefixes(percent)), "key binary, size long, grams array<long>, prefix int"), "classes")
    lists = hold(classes.select("key", "size", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("gram")), "lists")
    length = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).filter("n > 1").select(
        F.col("gram").alias("_g"), "n", "least")
    lists = hold(lists.join(length, F.col("gram") == F.col("_g")).drop("_g"), "lists")
    fits = 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")
    short = lists.filter(F.col("n") <= short_list)
    other = short.select(F.col("key").alias("b"), F.col("size").alias("size_b"), F.col("gram").alias("_g"))
    pairs = short.join(other, (F.col("gram") == F.col("_g")) & (F.col("key") < F.col("b")) & fits).select(
        F.col("key").alias("a"), "b", F.col("size").alias("size_a"), "size_b").distinct()
    # partial overlaps by fragment, summed per pair
    cut = classes.select("key", F.explode(F.transform("grams", lambda g: F.struct(F.shiftright(g, 60).alias("f"), g.alias("g")))).alias("x"))
    parts = cut.groupBy("key", "x.f").agg(F.collect_list("x.g").alias("g"))
    in_pairs = hold(pairs, "pairs")
    left = in_pairs.join(parts.select(F.col("key").alias("_k"), "f", "g"), F.col("a") == F.col("_k")).drop("_k")
    both = left.join(parts.select(F.col("key").alias("_k"), F.col("f").alias("_f"), F.col("g").alias("h")),
                     (F.col("b") == F.col("_k")) & (F.col("f") == F.col("_f")))
    overlap = both.groupBy("a", "b", "size_a", "size_b").agg(F.sum(F.size(F.array_intersect("g", "h"))).alias("o"))
    links = overlap.filter(100 * F.col("o") >= percent * (F.col("size_a") + F.col("size_b") - F.col("o"))).select("a", "b")
    long = lists.filter(F.col("n") > short_list)
    if long.limit(1).count():
        links = links.unionByName(_long_lists(long, classes, percent, block))
    return hold(links.distinct(), "links")


def _long_lists(long: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    groups = components(long.select(F.col("key").alias("a"), F.col("least").alias("b")))
    # sizes of linked sets differ by less than one class of this width
    width = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
    member = groups.join(classes, F.col("node") == F.col("key")).select("root", "key", "size", "grams", width.alias("w"))
    counts = member.groupBy("root", "w").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    near = counts.select(F.col("root").alias("_r"), (F.col("w") + 1).alias("_w"), F.col("blocks").alias("below"))
    above = counts.select(F.col("root").alias("_r2"), (F.col("w") - 1).alias("_w2"), F.col("blocks").alias("over"))
    counts = (counts.join(near, (F.col("root") == F.col("_r")) & (F.col("w") == F.col("_w")), "left")
              .join(above, (F.col("root") == F.col("_r2")) & (F.col("w") == F.col("_w2")), "left")
              .select(F.col("root").alias("_c"), F.col("w").alias("_cw"), "blocks", F.coalesce("below", F.lit(0)).alias("below"),
                      F.coalesce("over", F.lit(0)).alias("over")))
    member = member.join(counts, (F.col("root") == F.col("_c")) & (F.col("w") == F.col("_cw"))).withColumn(
        "own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    with_same = F.transform(numbers(F.col("blocks")), lambda i: F.struct(
        F.col("w").alias("w1"), F.least(i, F.col("own")).alias("b1"), F.col("w").alias("w2"), F.greatest(i, F.col("own")).alias("b2")))
    with_below = F.transform(numbers(F.col("below")), lambda i: F.struct(
        (F.col("w") - 1).alias("w1"), i.alias("b1"), F.col("w").alias("w2"), F.col("own").alias("b2")))
    with_over = F.transform(numbers(F.col("over")), lambda i: F.struct(
        F.col("w").alias("w1"), F.col("own").alias("b1"), (F.col("w") + 1).alias("w2"), i.alias("b2")))
    dealt = member.select("root", "key", "size", "grams", F.explode(F.concat(with_same, with_below, with_over)).alias("cell"))
    cell = F.xxhash64("root", "cell")
    return (dealt.select(cell.alias("cell"), "key", "size", "grams").repartition("cell").sortWithinPartitions("cell", "key")
            .mapInArrow(lean(_compare_blocks(percent)), "a binary, b binary"))


def _linked(docs: DataFrame, n: int, percent: int, short_list: int, block: int, bytes_per_fragment: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, text_hash, n_shingles, key``), and ``node, root`` of the classes with links."""
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    n_fragments = max(shuffle_parts(docs.sparkSession), input_bytes(docs) // bytes_per_fragment)
    # the sets are worked out twice: once for the digests, once cut up, which is cheaper than keeping them
    own = hold(source.mapInArrow(lean(_rows(n)), "doc_id long, text_hash long, n_shingles long, key binary"), "sets")
    cut = source.select("text").mapInArrow(
        lean(_cut_sets(n, n_fragments)), "frag int, keys binary, sizes binary, index binary, hashes binary")
    return own, components(link_classes(cut, n_fragments, percent, short_list, block))


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, short_list: int = 48, block: int = 256,
                     bytes_per_fragment: int = 32 << 20) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|``.
    """
    own, groups = _linked(docs, n, percent, short_list, block, bytes_per_fragment)
    least = own.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    group = groups.join(least, F.col("node") == F.col("key")).select("node", "root", "least")
    lowest = group.groupBy("root").agg(F.min("least").alias("lowest")).withColumnRenamed("root", "_r")
    named = group.join(lowest, F.col("root") == F.col("_r")).select("node", "lowest")
    of_class = hold(least.join(named, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias("_k"), F.coalesce("lowest", "least").alias("component")), "components")
    return own.join(of_class, F.col("key") == F.col("_k"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, short_list: int = 48, block: int = 256,
                     bytes_per_fragment: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: the smallest ``doc_id`` of every group (null ids last), and all without words.

    Rows are told apart by id and text; of rows equal in both one stays.
    """
    own, groups = _linked(docs, n, percent, short_list, block, bytes_per_fragment)
    named = own.filter("key is not null").groupBy("key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    named = named.join(groups, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "key"))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    best = named.groupBy("group").agg(F.min(order).alias("best")).select(F.col("group").alias("_g"), "best")
    verdict = hold(named.join(best, F.col("group") == F.col("_g")).select(
        F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash"),
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))).alias("stays"), "n"), "near")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__near_id")) & (F.col("__near_text") == F.col("__near_hash"))
    marked = docs.withColumn("__near_text", F.xxhash64(F.col("text").cast("string")))
    left = marked.join(verdict.filter("not stays").select("__near_id", "__near_hash"), same, "left_anti")
    twice = verdict.filter("stays and n > 1").select("__near_id", "__near_hash")
    if not twice.limit(1).count():
        return left.drop("__near_text")
    return left.join(twice, same, "left_anti").unionByName(
        left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__near_text"])).drop("__near_text")
