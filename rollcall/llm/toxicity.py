"""Toxicity by nearest labelled examples under exact weighted TF-IDF cosine.

* Fit: at most ``sample_rows`` labelled rows (in the order of a hash of
  ``doc_id``) are the examples.  All their words are terms.  Words and
  beginnings of four to six letters whose share among toxic examples is at
  least ``least_lift`` times that among others, with chi-square ``least_chi2``
  or more (at most ``most_terms``), are *marks*: such beginnings are terms too,
  and terms that are no marks weigh ``plain`` times as much.
* Term counts of every whole text and document frequencies over all documents
  give the TF-IDF vectors.
* The most frequent terms of the examples are a matrix that many queries at a
  time are multiplied with.  Of every other term and block of examples the index
  knows the largest weight.  A query adds these up to a bound per block, reads
  blocks in falling order of the bound, and stops when no bound reaches its
  ``k``-th best cosine; what is near it is summed again in double precision, so
  the neighbours are exact.
* Neighbours vote with their cosine; the vote is mapped to a probability by a
  monotone fit on votes of the examples about each other (each left out).

The index is bounded by the words of ``sample_rows`` texts; their packed term
counts are broadcast and every worker builds the index once.  The examples ask
each other in a Spark job of their own; only their votes, one number each,
come back for the monotone fit.
A score depends on the text alone.

Defined results: a null text counts as empty; texts without any known term get
the share of toxic examples among such examples (the share among all counts
as one such example); without toxic examples every
score is 0; ties between examples go to the smaller id; an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.spread import shuffle_parts
from rollcall.llm.common import crc32_of, hold, lean

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)


def forms(word: str) -> list[str]:
    """The terms of a word: itself, and its beginnings (marked)."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def word_counts(text: str | None) -> dict[str, int]:
    """How often a text has each word (by ``WORD``), in lower case."""
    found = Counter((text or "").lower().split())
    # pieces between white space that are more than letters are few different ones
    for piece in [p for p in found if not p.isalpha()]:
        n = found.pop(piece)
        for word in WORD.findall(piece):
            found[word] = found.get(word, 0) + n
    return found


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, toxic and not, summed within the task."""
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else clean).update({f for w in word_counts(text) for f in forms(w)})
    terms = list(toxic.keys() | clean.keys())
    for at in range(0, len(terms), 50_000):
        part = terms[at:at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())],
            names=["term", "bad", "good"])


def count_terms(examples: DataFrame) -> DataFrame:
    """``term, bad, good``: examples (``text``, ``label``) with each term, toxic and not."""
    counts = examples.select(F.col("text"), F.col("label")).mapInArrow(_count_terms, "term string, bad long, good long")
    return counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def choose_terms(counts: DataFrame, n_bad: int, n_good: int, least_chi2: float, least_lift: float, most_terms: int) -> list[str]:
    """Terms that mark toxic examples."""
    n, seen = n_bad + n_good, F.col("bad") + F.col("good")
    gap = F.col("bad") * n_good - F.col("good") * n_bad
    chi2 = gap.cast("double") ** 2 * n / (seen * (n - seen) * float(n_bad) * n_good)
    rows = (counts.filter("bad >= 3").filter((F.col("bad") * n_good >= least_lift * F.col("good") * n_bad) & (seen < n))
            .withColumn("chi2", chi2).filter(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "term").limit(most_terms).collect())
    return [r["term"] for r in rows]


def _vectors(terms: list[str]):
    """Counts of the terms in every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        first = STEMS[0]
        begun = {t[:first] for t in terms if t.endswith("*")}  # few words begin as a mark does
        for batch in batches:
            ids, counts, sizes = [], [], [0]
            for text in batch.column(2).to_pylist():
                words = word_counts(text)
                found = dict(zip(map(number.get, words), words.values()))
                found.pop(None, None)
                for word in [w for w in words if w[:first] in begun]:
                    for form in forms(word)[1:]:
                        t = number.get(form)
                        if t is not None:
                            found[t] = found.get(t, 0) + words[word]
                order = sorted(found)
                ids += order
                counts += map(found.__getitem__, order)
                sizes.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(v, k)) for v, k in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "terms", "counts"])

    return run


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of many ranges, one range after the other."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class BlockMaxIndex:
    """Unit vectors for exact searches: the terms that most of them have as columns of a matrix, all others as postings.

    Equal vectors are one row.  The products of the ``head`` most frequent
    terms are matrix products of many queries at a time, in single precision.
    Other terms have postings by term and block of rows, with the largest
    weight of each pair that occurs.  Rows that reach the ``k``-th best but for
    the rounding of single precision are summed again in double precision.
    """

    BATCH = 64  # queries of one matrix product

    def __init__(self, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, block: int = 8192, head: int = 512):
        """``sizes`` terms of every vector, and ``term``, ``weight`` of all vectors one after the other."""
        ends = np.cumsum(sizes)
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(hashlib.blake2b(term[a:b].tobytes() + weight[a:b].tobytes(), digest_size=16).digest(), len(number))
                       for a, b in zip((ends - sizes).tolist(), ends.tolist())], np.int64)
        self.member = np.argsort(of, kind="stable")  # vectors by row, smallest number first
        self.member_at = np.searchsorted(of[self.member], np.arange(len(number) + 1))
        lead = self.member[self.member_at[:-1]]
        if len(lead) < len(sizes):
            post = _spans((ends - sizes)[lead], ends[lead])
            sizes, term, weight = sizes[lead], term[post], weight[post]
        self.n, self.block = len(sizes), block
        self.blocks = -(-max(self.n, 1) // block)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.term, self.own = term.astype(np.int32), weight
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.longest = float(np.sqrt(np.bincount(row, weight * weight, self.n).max(initial=0)))
        times = np.bincount(self.term, minlength=n_terms)
        top = np.argsort(-times, kind="stable")[:head]
        top = top[times[top] > self.n // 256]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[top] = np.arange(len(top))
        column = self.column[self.term]
        often = column >= 0
        self.head = np.zeros((self.n, len(top)), np.float32)
        self.head[row[often], column[often]] = weight[often]
        rest = np.flatnonzero(~often)
        del column, often
        rest = rest[np.argsort(self.term[rest], kind="stable")]  # rows are in order already
        self.row, self.weight = row[rest], weight[rest].astype(np.float32)
        cell = self.term[rest].astype(np.int64) * self.blocks + self.row // block
        del row, rest
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.start = np.append(first, len(cell))  # postings of every (term, block) that occurs
        self.of = (cell[first] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.cells = np.searchsorted(cell[first] // self.blocks, np.arange(n_terms + 1))
        self.room = np.zeros(n_terms)

    def search(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int,
               skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of many queries the vectors with the ``k`` largest positive dot products, largest first, ties to the smaller number.

        ``skip``: of each query, the number of a vector that takes no part.
        """
        at = np.concatenate([[0], np.cumsum(sizes)])
        for low in range(0, len(sizes), self.BATCH):
            high = min(low + self.BATCH, len(sizes))
            of = np.repeat(np.arange(high - low), sizes[low:high])
            column = self.column[terms[at[low]:at[high]]]
            often = column >= 0
            asked = np.zeros((high - low, self.head.shape[1]), np.float32)
            asked[of[often], column[often]] = weights[at[low]:at[high]][often]
            head = asked @ self.head.T
            for i in range(low, high):
                own = slice(at[i], at[i + 1])
                yield self._nearest(terms[own], weights[own], head[i - low], k, -1 if skip is None else int(skip[i]))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``search`` of one query."""
        return next(self.search(np.array([len(terms)]), terms, weights, k, np.array([skip])))

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, head: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        # how far a sum in single precision can be from the exact one: no summand is negative
        slack = (self.head.shape[1] + 16) * 2.0 ** -23 * float(np.sqrt((weights * weights).sum())) * self.longest
        rest = self.column[terms] < 0
        low, high = self.cells[terms[rest]], self.cells[terms[rest] + 1]
        cells, own = _spans(low, high), np.repeat(weights[rest].astype(np.float32), high - low)
        of = self.of[cells]
        bound = np.bincount(of, own * self.most[cells], self.blocks) + np.maximum.reduceat(head, np.arange(0, self.n, self.block))
        near, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            # blocks in falling order of the bound; one row more than asked for, as one may be skipped
            if bound[b] <= 0 or bound[b] < least - 2 * slack:
                break
            base = b * self.block
            total = head[base:base + self.block]
            use = np.flatnonzero(of == b)
            if len(use):
                c = cells[use]
                x, y = self.start[c], self.start[c + 1]
                post = _spans(x, y)
                part = self.weight[post]
                part *= np.repeat(own[use], y - x)
                total = total + np.bincount(self.row[post] - base, part, len(total))
            hit = np.flatnonzero((total > 0) & (total >= least - 2 * slack))
            near, score = np.append(near, hit + base), np.append(score, total[hit])
            if len(near) > k + 1:
                least = float(np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                stay = score >= least - 2 * slack
                near, score = near[stay], score[stay]
        # the exact sums of what is left, in ascending order of terms
        size = self.at[near + 1] - self.at[near]
        post = _spans(self.at[near], self.at[near + 1])
        self.room[terms] = weights
        part = self.room[self.term[post]] * self.own[post]
        self.room[terms] = 0
        score = np.bincount(np.repeat(np.arange(len(near)), size), part, len(near))
        near, score = near[score > 0], score[score > 0]
        first = self.member_at[near]
        times = np.minimum(self.member_at[near + 1] - first, k + 1)
        best, score = self.member[_spans(first, first + times)], np.repeat(score, times)
        best, score = best[best != skip], score[best != skip]
        order = np.lexsort((best, -score))[:k]
        return best[order], score[order]


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit as (vote, probability) knots, smoothed by half an example of each kind per step."""
    order = np.argsort(votes, kind="stable")
    steps: list[list[float]] = []
    for v, y in zip(votes[order].tolist(), labels[order].tolist()):
        steps.append([v, v, float(y), 1.0])
        while len(steps) > 1 and (steps[-2][1] == steps[-1][0] or steps[-2][2] / steps[-2][3] >= steps[-1][2] / steps[-1][3]):
            low, high, good, n = steps.pop()
            steps[-1] = [steps[-1][0], high, steps[-1][2] + good, steps[-1][3] + n]
    xs = np.array([x for s in steps for x in s[:2]])
    ps = np.maximum.accumulate(np.array([(s[2] + 0.5) / (s[3] + 1) for s in steps for _ in range(2)]))
    return xs, ps


def units(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted TF-IDF vectors of length one, one after the other: (1 + log count) * idf, with the weights in ``idf``."""
    w = (1 + np.log(counts)) * idf[terms]
    length = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w * w, len(sizes))
    return w / np.repeat(np.sqrt(length), sizes)


class NearestExamples:
    """The scorer: ids, labels and packed term counts of the examples, idf; with knots, the calibration.

    Only the packed counts travel; the index is built where it is first asked for.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray,
                 share_without: float, k: int):
        self.ids, self.labels, self.sizes = ids, labels.astype(float), sizes
        self.packed = [zlib.compress(np.ascontiguousarray(f, np.int32), 1) for f in (terms, counts)]
        self.idf, self.k, self.share_without = idf, k, share_without
        self.built: BlockMaxIndex | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    @property
    def index(self) -> BlockMaxIndex:
        if self.built is None:
            terms, counts = (np.frombuffer(zlib.decompress(f), np.int32) for f in self.packed)
            self.built = BlockMaxIndex(self.sizes, terms, units(self.sizes, terms, counts, self.idf), len(self.idf))
        return self.built

    def _search(self, terms: pa.ListArray, counts: pa.ListArray, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = pc.list_value_length(terms).to_numpy().astype(np.int64)
        flat, times = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        return self.index.search(sizes, flat, units(sizes, flat, times, self.idf), self.k, skip)

    def votes(self, terms: pa.ListArray, counts: pa.ListArray, skip: np.ndarray) -> list[float]:
        return [self._vote(*found) for found in self._search(terms, counts, skip)]

    def _vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine * self.labels[near]).sum() + 0.5 * self.share_without) / float(cosine.sum() + 0.5)

    def scores(self, terms: pa.ListArray, counts: pa.ListArray, knots: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[int]]]:
        out = []
        for size, (near, cosine) in zip(pc.list_value_length(terms).to_pylist(), self._search(terms, counts)):
            if not size:
                out.append((self.share_without, []))
                continue
            p = float(np.interp(self._vote(near, cosine), *knots))
            out.append((min(1.0, max(0.0, p)), self.ids[near[self.labels[near] == 1][:3]].tolist()))
        return out


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_terms: int = 2_048, least_chi2: float = 25.0,
             least_lift: float = 4.0, k: int = 10, held_out: int = 2, cut: float = 0.3, plain: float = 0.1) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row.

    Learns from labelled rows whose crc32 modulo 4 is not ``held_out``.
    ``evidence`` lists the ids of up to three nearest toxic examples.
    """
    spark = docs.sparkSession
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    told = told.filter(crc32_of(F.col("_id")) % 4 != held_out).orderBy(crc32_of(F.col("_id")), "_id").limit(sample_rows)
    told = F.broadcast(hold(told, "labels"))  # at most sample_rows rows of two numbers
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    examples = source.join(told, F.col("doc_id") == F.col("_id"))
    size = examples.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    terms, marks = [], set()
    if size["bad"]:
        counts = hold(count_terms(examples), "counts")
        if size["bad"] < size["n"]:
            marks = set(choose_terms(counts, size["bad"], size["n"] - size["bad"], least_chi2, least_lift, most_terms))
        words = counts.filter(~F.col("term").endswith("*")).select("term").toArrow().column(0).to_pylist()
        terms = sorted(marks.union(words))
    rows = hold(source.join(told, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "label", "text")
                .mapInArrow(lean(_vectors(terms)), "doc_id long, label int, terms array<int>, counts array<long>"), "terms")
    idf = np.zeros(max(1, len(terms)))
    n_docs = rows.count()
    seen = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    idf[seen["t"].to_numpy()] = np.log((1 + n_docs) / (1 + seen["df"].to_numpy())) + 1
    weight = idf * np.array([1.0 if t in marks else plain for t in terms] or [1.0])
    least = F.min(F.struct("label", "terms", "counts")).alias("r")  # of rows with one id, the same one on every retry
    marked = rows.filter("label is not null").groupBy("doc_id").agg(least).select("doc_id", "r.*")
    without = marked.filter(F.size("terms") == 0).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    share = (without["bad"] + size["bad"] / size["n"]) / (without["n"] + 1) if size["bad"] else 0.0
    told = hold(marked.filter(F.size("terms") > 0), "examples")
    flat = told.toArrow().sort_by("doc_id").combine_chunks()  # at most sample_rows rows of term numbers and counts
    ids, label = (flat[c].to_numpy() for c in ("doc_id", "label"))
    sizes = pc.list_value_length(flat["terms"]).to_numpy().astype(np.int64)
    found, counted = (pc.list_flatten(flat[c]).to_numpy() for c in ("terms", "counts"))
    model = spark.sparkContext.broadcast(NearestExamples(ids, label, sizes, found, counted, weight, min(share, 0.5), k))
    del flat, found, counted

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            names, at = batch.column(0), np.searchsorted(own.ids, batch.column(0).to_numpy())
            out = own.votes(batch.column(2), batch.column(3), at)
            yield pa.RecordBatch.from_arrays([names, batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "label", "vote"])

    # every example asks the others; the votes, one number an example, come back for the monotone fit
    voted = told.repartition(shuffle_parts(spark), "doc_id").mapInArrow(lean(votes), "doc_id long, label int, vote double").toArrow().sort_by("doc_id")
    knots = monotone(voted["vote"].to_numpy(), voted["label"].to_numpy().astype(float)) if len(voted) else (np.zeros(1), np.zeros(1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            out = own.scores(batch.column(2), batch.column(3), knots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.float64()),
                 pa.array([int(o[0] >= cut) for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "score", "predicted", "evidence"])

    side = F.coalesce(crc32_of(F.col("doc_id")) % 4 == held_out, F.lit(False)).alias("held_out")
    return rows.select("doc_id", side, "terms", "counts").mapInArrow(
        lean(score), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
