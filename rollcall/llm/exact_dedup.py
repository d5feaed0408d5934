"""Exact de-duplication: Patricia-trie owners of (length, content hash) partitions.

1. Every task of the scan folds equal texts of its own rows into *entries*
   (an epoch ends after ``EPOCH_BYTES`` of different text, so the table of a
   task is bounded).  A text held by a third of all rows becomes one entry per
   epoch here, before anything is shuffled.
2. Entries go to owners by (length, hash).  An owner inserts the full byte
   strings into a compressed radix trie; a terminal node holds the identifier
   that stays, the row count and the entries it stands for.  Above
   ``TRIE_BYTES`` the heaviest subtree below the root is spilled to an
   anonymous temporary file; its later strings are appended there, and spilled
   subtrees are built one after the other at the end.
3. Rows take the verdict of their entry by a join on the entry number, which
   no more rows share than one epoch holds.

Defined results: a null text counts as empty; texts are equal when identical
after lower-casing A-Z.  Of equal rows the one with the largest (``keep="max"``)
or smallest (``keep="min"``) identifier stays, null identifiers last; of rows
that tie, the one read first; exactly one row of every group is kept.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import ASCII_LOWER, ascii_lower, hold

EPOCH_BYTES = 32 << 20
TRIE_BYTES = 96 << 20


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection on slice equality."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Compressed radix trie from byte strings to merged payloads, spilling by subtree.

    A node is ``[edge, children, payload]``.  ``merge(old, new)`` combines the
    payloads of one string.  ``items`` may be read once, after all inserts.
    """

    def __init__(self, merge, limit: int = TRIE_BYTES):
        self.merge, self.limit = merge, limit
        self.root = [b"", {}, None]
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def insert(self, key: bytes, payload) -> None:
        head = key[0] if key else -1
        if head in self.spilled:
            pickle.dump((key, payload), self.spilled[head])
            return
        node, at, new = self.root, 0, 0
        while True:
            if at == len(key):
                node[2] = payload if node[2] is None else self.merge(node[2], payload)
                break
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, payload]
                new = len(key) - at + 200
                break
            edge = child[0]
            if not key.startswith(edge, at):
                cut = shared_prefix(edge, key[at:at + len(edge)])
                upper = [edge[:cut], {edge[cut]: child}, None]
                child[0] = edge[cut:]
                node[1][key[at]] = child = upper
                new += 200
            node, at = child, at + len(child[0])
        if new and head >= 0:
            self.weight[head] = self.weight.get(head, 0) + new
            if sum(self.weight.values()) > self.limit:
                self._spill(max(self.weight, key=self.weight.get))

    def _spill(self, head: int) -> None:
        file = tempfile.TemporaryFile()
        for item in self._walk(self.root[1].pop(head), b""):
            pickle.dump(item, file)
        self.spilled[head] = file
        del self.weight[head]

    @staticmethod
    def _walk(node, before: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, before)]
        while stack:
            (edge, children, payload), prefix = stack.pop()
            prefix += edge
            if payload is not None:
                yield prefix, payload
            stack.extend((c, prefix) for c in children.values())

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from self._walk(self.root, b"")
        self.root, self.weight = [b"", {}, None], {}
        for head, file in self.spilled.items():
            # the subtree is built without its common first bytes, so that it can be cut again
            file.seek(0)
            sub, prefix = None, b""
            for key, payload in _pickled(file):
                prefix = key if sub is None else prefix[:shared_prefix(prefix, key)]
                sub = True
            file.seek(0)
            below = PatriciaTrie(self.merge, self.limit)
            for key, payload in _pickled(file):
                below.insert(key[len(prefix):], payload)
            file.close()
            for key, payload in below.items():
                yield prefix + key, payload


def _pickled(file) -> Iterator:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


ROWS = "doc_id long, row long, entry long, text_sha256 string, size long, hash long, n long, body binary"
NAMES = ["doc_id", "row", "entry", "text_sha256", "size", "hash", "n", "body"]


def _ranked(keep: str):
    """Sort key of (identifier, row): the greatest stays."""
    flip = 1 if keep == "max" else -1
    return lambda best_id, row: (best_id is not None, flip * (best_id or 0), -row)


def _entries(keep: str, normalise: bool):
    """Map side: number the rows, fold equal texts of an epoch into entries.

    Gives one line per row (``n`` null) and, at the end of an epoch, one per
    entry, with its string, its best identifier and row, and its count.
    """
    rank = _ranked(keep)

    def closed(known: dict) -> pa.RecordBatch:
        made = list(known.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], kind) for i, kind in ((3, pa.int64()), (4, pa.int64()), (0, pa.int64()))]
            + [pa.nulls(len(made), pa.string()), pa.array([len(k) for k in known], pa.int64())]
            + [pa.array([m[i] for m in made], pa.int64()) for i in (2, 5)]
            + [pa.array(list(known), pa.binary())], names=NAMES)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        row, entry, held = base, base, 0
        known: dict[bytes, list] = {}  # string -> entry, digest, hash, best id, best row, count
        for batch in batches:
            ids, first = batch.column(0).to_pylist(), row
            entries, digests = [], []
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                data = (text or "").encode()
                if normalise:
                    data = data.translate(ASCII_LOWER)
                got = known.get(data)
                if got is None:
                    if held > EPOCH_BYTES:
                        yield closed(known)
                        known, held = {}, 0
                    digest = hashlib.sha256(data)
                    got = known[data] = [entry, digest.hexdigest(),
                                         int.from_bytes(digest.digest()[:8], "little", signed=True), doc_id, row, 0]
                    entry += 1
                    held += len(data) + 300
                elif rank(doc_id, row) > rank(got[3], got[4]):
                    got[3], got[4] = doc_id, row
                got[5] += 1
                entries.append(got[0])
                digests.append(got[1])
                row += 1
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(range(first, row), pa.int64()), pa.array(entries, pa.int64()),
                 pa.array(digests, pa.string()), none, none, none, pa.nulls(len(ids), pa.binary())], names=NAMES)
        if known:
            yield closed(known)

    return fold


def _own(keep: str):
    """Owner side: one trie per partition of (length, hash) keys."""
    rank = _ranked(keep)

    def merge(old, new):
        best = old if rank(*old[:2]) >= rank(*new[:2]) else new
        return best[0], best[1], old[2] + new[2], old[3] + new[3]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(merge)
        for batch in batches:
            for entry, body, best_id, best_row, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                trie.insert(body, (best_id, best_row, n, [entry]))
        out: list[list] = [[], [], [], []]
        for _, (best_id, best_row, n, entries) in trie.items():
            for e in entries:
                for col, v in zip(out, (e, best_id, best_row, n)):
                    col.append(v)
            if len(out[0]) > 20_000:
                yield _batch(out)
                out = [[], [], [], []]
        yield _batch(out)

    return own


def _batch(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                      names=["_entry", "keep_id", "keep_row", "group_size"])


def exact_dedup(docs: DataFrame, keep: str = "max", normalise: bool = True) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (``doc_id``, ``text``)."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    rows = hold(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .mapInArrow(_entries(keep, normalise), ROWS), "exact")
    owned = (rows.filter(F.col("n").isNotNull()).select("entry", "body", "doc_id", "row", "n", "size", "hash")
             .repartition("size", "hash")
             .mapInArrow(_own(keep), "_entry long, keep_id long, keep_row long, group_size long"))
    owned = hold(owned, "owners")
    return (rows.filter(F.col("n").isNull()).select("doc_id", "row", "entry", "text_sha256")
            .join(owned, F.col("entry") == F.col("_entry"))
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max", normalise: bool = True) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of every group of equal texts.

    Rows that go are found by id and digest; rows equal in both are told apart
    by a number within the scan, so exactly one of them stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = ascii_lower(text) if normalise else text
    verdict = exact_dedup(docs, keep, normalise)
    stays = verdict.filter("kept").select(F.col("doc_id").alias("__dup_id"), F.col("text_sha256").alias("__dup_sha"))
    marked = docs.withColumn("__dup_digest", F.sha2(body.cast("binary"), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__dup_id")) & (F.col("__dup_digest") == F.col("__dup_sha"))
    left = marked.join(stays, same, "left_semi")
    # rows equal in id and digest all found the one that stays: keep the first of each such pair
    twice = verdict.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("doc_id").alias("__dup_id"), F.col("text_sha256").alias("__dup_sha"))
    if not twice.limit(1).count():
        return left.drop("__dup_digest")
    single = left.join(twice, same, "left_anti")
    several = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__dup_digest"])
    return single.unionByName(several).drop("__dup_digest")
