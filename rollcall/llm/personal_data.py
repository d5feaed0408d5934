"""Personal data by bootstrapped contextual extraction.

1. Seeds: strict forms of four kinds, found by scanning every whole text.
2. Candidates: looser forms (an address without a dot or with its signs spelt
   out, an address of colon groups, a long number that fails its check digit, a
   telephone number without a plus, and the parts of runs in which numbers stand
   side by side and spoil each other's strict form) that overlap no seed.  They
   are not spans yet.
3. Lexical patterns: the word to the left, the two words to the left and the
   word to the right of a mention, and the shape of a number (digits as 0, with
   its check digit right or wrong).  A second scan counts how often the words
   occur anywhere, so that a pattern is measured against everything that fills
   its slot; only mentions have a shape.
4. The graph of patterns and instances (kind, normalised value) is scored in
   rounds of joins: the confidence of a pattern is t / (t + other + unknown / 4 + 1)
   with t the confidence of its trusted instances, each counted once, ``other``
   the occurrences filled by no mention of the kind and ``unknown`` the number of
   its untrusted instances.
   Patterns of at least ``least`` with ``support`` different trusted instances
   make their candidates trusted, with 1 - product(1 - confidence); rounds go on
   until none is new.  A candidate with the value of a seed is trusted from the
   start.  Every mention of a trusted candidate becomes a span.

Edges are folded to (kind, value, context) with a count before they move, so
copies of a document weigh nothing in a join, and copies of a seed do not make a
pattern more believable.  Contexts to be counted travel as a bitmap of 2^20
hash positions (a fixed size; what collides is told apart by the later join).

Defined results: a null text has no spans; rows with null or repeated ids are
rows like any others; offsets are code points, ends exclusive; context words of
more than 64 characters are no context; an empty table gives no rows; columns
beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import discard, hold

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
HOST = re.compile(r"[A-Za-z0-9-]++(?![A-Za-z0-9.-])")
# possessive and anchored at the start of a run: the matches of the plain forms, in time linear in the text
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELT = re.compile(r" ?[\[(][Aa][Tt][\])] ?")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:[\[(][Dd][Oo][Tt][\])]|\.) ?[A-Za-z0-9-]++)++")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
CLUSTER = re.compile(r"(?<![0-9A-Za-z(])\(?[0-9](?:[ ().-]{0,3}[0-9])++(?![0-9A-Za-z])")
DIGIT = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")
EDGE = re.compile(r"^\W+|\W+$")
WORD_CHARS = 64
BITS = 1 << 20

MENTION = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
                        T.StructField("text", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("v", T.StringType()),
                        T.StructField("c", T.ArrayType(T.StringType()))])


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Strict addresses, and what has an at sign but no dot behind it."""
    good, loose, end = [], [], 0
    at = text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            good.append((start, m.end()))
        elif start < at and (h := HOST.match(text, at + 1)):
            loose.append((start, h.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return good, loose


def quads(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in QUAD.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Card numbers, numbers of their length with a wrong check digit, and parts of longer runs."""
    good, loose = [], []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 13:
            d = NOT_DIGITS.sub("", m.group())
            if 13 <= len(d) <= 19:
                (good if luhn(d) else loose).append(m.span())
            elif len(d) > 19:
                loose += crowded(text, *m.span())
    return good, loose


def crowded(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Parts of card length in a run of more digits than one number has: single groups, or four groups of four that check."""
    groups = [(s + m.start(), s + m.end()) for m in re.finditer("[0-9]+", text[s:e])]
    out, i = [], 0
    while i < len(groups):
        four = groups[i:i + 4]
        if 13 <= groups[i][1] - groups[i][0] <= 19:
            out.append(groups[i])
        elif len(four) == 4 and all(b - a == 4 for a, b in four) and luhn("".join(text[a:b] for a, b in four)):
            out.append((four[0][0], four[3][1]))
            i += 3
        i += 1
    return out


def calls(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Telephone numbers, and the likeliest beginnings (to a space) of runs of too many digits."""
    good, loose = [], []
    for m in CALL.finditer(text):
        digits = len(NOT_DIGITS.sub("", m.group()))
        if 9 <= digits <= 15:
            good.append(m.span())
        elif digits > 15:
            ends, n = [], 0
            for g in re.finditer(r"[^ ]+", m.group()):
                n += len(NOT_DIGITS.sub("", g.group()))
                if n > 15:
                    break
                if n >= 9:
                    ends.append((n < 10, m.start() + g.end()))
            if ends:
                loose.append((m.start(), min(ends)[1]))
    return good, loose


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms, by kind, then start."""
    return scan(text)[0]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Seeds, and candidates that overlap neither seeds nor each other."""
    loose: list[tuple[int, int, int]] = []
    base: list[tuple[int, int, int]] = []
    if "@" in text:
        good, open_ = emails(text)
        base += [(EMAIL, *x) for x in good]
        loose += [(EMAIL, *x) for x in open_]
    if "[" in text or "(" in text:
        end = 0
        for m in SPELT.finditer(text):
            start = end + len(text[end:m.start()].rstrip(LOCAL))
            if start < m.start() and (d := SPELT_DOMAIN.match(text, m.end())):
                loose.append((EMAIL, start, d.end()))
            end = m.end()
    if DIGIT.search(text):
        base += [(IP, *x) for x in quads(text)]
        good, open_ = numbers(text)
        said, begun = calls(text)
        base += [(CARD, *x) for x in good] + [(PHONE, *x) for x in said]
        loose += [(PHONE, *x) for x in begun]
        around = lambda s, e: not (text[s - 1:s].isalnum() or text[e:e + 1].isalnum())
        loose += [(CARD, s, e) for s, e in open_ if around(s, e)]
        loose += [(PHONE, *m.span()) for m in CLUSTER.finditer(text) if 7 <= len(NOT_DIGITS.sub("", m.group())) <= 15]
    if "::" in text or text.count(":") > 2:
        loose += [(IP, *m.span()) for m in COLONS.finditer(text)]
    out, taken = [], sorted((s, e) for _, s, e in base)
    i, last = 0, 0
    for k, s, e in sorted(loose, key=lambda x: (x[1], x[0], -x[2])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        # seeds of different kinds may overlap; every one that ends behind s is looked at until one starts behind e
        if s >= last and not any(a < e and b > s for a, b in _until(taken, i, e)):
            out.append((k, s, e))
            last = e
    return base, out


def _until(taken: list[tuple[int, int]], i: int, e: int) -> Iterator[tuple[int, int]]:
    while i < len(taken) and taken[i][0] < e:
        yield taken[i]
        i += 1


@lru_cache(maxsize=1 << 16)
def plain(word: str) -> str:
    """A word as patterns know it: lower case, digits as 0, signs at the edges only where there is nothing else."""
    low = word.lower()
    return DIGIT.sub("0", EDGE.sub("", low) or low)


def contexts(text: str, kind: int, s: int, e: int) -> list[str]:
    """The patterns a mention stands in: L (left word), B (two left words), R (right word), S (shape of a number)."""
    reach = 2 * WORD_CHARS + 4
    left, right = text[max(0, s - reach):s].split(), text[e:e + WORD_CHARS + 2].split()
    if s > reach and left and not text[s - reach - 1].isspace():
        left = left[1:]
    if e + WORD_CHARS + 2 < len(text) and len(right) == 1 and not text[e + WORD_CHARS + 2].isspace():
        right = []
    left, out = left[-2:], []
    if left and len(left[-1]) <= WORD_CHARS:
        out.append("L " + plain(left[-1]))
        if len(left) == 2 and len(left[0]) <= WORD_CHARS:
            out.append(f"B {plain(left[0])} {plain(left[1])}")
    if right and len(right[0]) <= WORD_CHARS:
        out.append("R " + plain(right[0]))
    if kind in (CARD, PHONE) and e - s <= WORD_CHARS:
        checks = kind == CARD and luhn(NOT_DIGITS.sub("", text[s:e]))
        out.append("S " + DIGIT.sub("0", text[s:e]) + (" checks" if checks else ""))
    return out


def value(kind: int, text: str) -> str:
    """Different spellings of one identifier are one instance."""
    if kind in (CARD, PHONE):
        return NOT_DIGITS.sub("", text)
    low = text.lower()
    return re.sub(r" ?[\[(]dot[\])] ?", ".", SPELT.sub("@", low)) if kind == EMAIL else low


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, row number and all seeds and candidates of every row."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            lists = []
            for text in b["text"]:
                text = text or ""
                base, loose = scan(text)
                lists.append([(k, s, e, text[s:e], seed, value(k, text[s:e]), contexts(text, k, s, e))
                              for seed, spans in ((True, base), (False, loose)) for k, s, e in spans])
            yield pd.DataFrame({"doc_id": b["doc_id"], "_row": np.arange(row, row + len(b)), "m": lists})
            row += len(b)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("_row", T.LongType()), T.StructField("m", T.ArrayType(MENTION))])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(found, schema)


def context_counts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, total): occurrences of the contexts ``keys`` in all texts, whatever stands beside them."""
    rows = keys.select(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(BITS)).cast("int").alias("p")).distinct().collect()  # at most BITS rows
    if not rows:
        return docs.sparkSession.createDataFrame([], "key string, total long")
    bits = np.zeros(BITS, dtype=bool)
    bits[[r["p"] for r in rows]] = True
    bits = np.packbits(bits).tobytes()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda key: bits[(p := zlib.crc32(key.encode("utf-8", "surrogatepass")) % BITS) >> 3] >> (7 - (p & 7)) & 1
        for b in batches:
            words, pairs, total = Counter(), Counter(), Counter()
            split = [t.split() for t in b["text"] if t]
            for ws in split:
                words.update(ws)
            second = set()
            for w, n in words.items():
                if len(w) <= WORD_CHARS:
                    for side in "LR":
                        if known(key := f"{side} {plain(w)}"):
                            total[key] += n
                            second.add(w)
            for ws in split:
                pairs.update(x for x in zip(ws, ws[1:]) if x[1] in second)
            for (a, w), n in pairs.items():
                if len(a) <= WORD_CHARS and known(key := f"B {plain(a)} {plain(w)}"):
                    total[key] += n
            if total:
                yield pd.DataFrame({"key": list(total), "total": list(total.values())})

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
    return texts.mapInPandas(count, "key string, total long").groupBy("key").agg(F.sum("total").alias("total"))


def trusted(found: DataFrame, docs: DataFrame, least: float, support: int) -> DataFrame:
    """(k, v, conf) of every trusted instance: seeds with 1, candidates by the patterns they stand in."""
    m = found.select(F.explode("m").alias("_m")).select("_m.*")
    sure = hold(m.groupBy("k", "v").agg(F.max("seed").alias("seed")), "personal-instances")
    accepted = sure.filter("seed").select("k", "v", F.lit(1.0).alias("conf"))
    edges = hold(m.select("k", "v", "seed", F.explode("c").alias("key")).groupBy("k", "v", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "personal-edges")
    # a pattern matters when it has a candidate to give and instances enough to be believed; without its left word a pair isn't counted
    keys = edges.groupBy("k", "key").agg(F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("seed")).alias("_open")).filter(
        (F.col("_all") > support) & (F.col("_open") > 0)).select("k", "key")
    graph = hold(edges.join(keys, ["k", "key"], "left_semi"), "personal-graph")
    if graph.isEmpty():
        return accepted
    wanted = graph.filter(~F.col("key").startswith("S ")).select("key").distinct()
    left = wanted.filter(F.col("key").startswith("B ")).select(F.concat(F.lit("L "), F.substring_index("key", " ", -1)).alias("key"))
    totals = hold(context_counts(docs, wanted.unionByName(left)), "personal-totals")
    while True:
        joined = graph.join(accepted, ["k", "v"], "left")
        pattern = joined.groupBy("k", "key").agg(F.sum("conf").alias("t"), F.sum("n").alias("slot"), F.count("conf").alias("_support"),
                                                 F.count_if(F.col("conf").isNull()).alias("_open"))
        pattern = pattern.filter((F.col("_support") >= support) & (F.col("_open") > 0)).join(totals, "key", "left")
        other = F.greatest(F.coalesce("total", F.lit(0)) - F.col("slot"), F.lit(0))
        conf = F.col("t") / (F.col("t") + other + F.col("_open") / 4 + 1)
        pattern = pattern.select("k", "key", conf.alias("p")).filter(F.col("p") >= least)
        new = graph.join(accepted, ["k", "v"], "left_anti").join(pattern, ["k", "key"]).groupBy("k", "v").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("conf"))
        new = hold(new, "personal-new")
        if new.isEmpty():
            discard(edges, graph, totals)
            return accepted
        accepted = accepted.unionByName(new)


def find(docs: DataFrame, least: float = 0.75, support: int = 3) -> DataFrame:
    """One row per document: doc_id and ``spans``, by kind, then start."""
    found = hold(mentions(docs), "personal")
    m = found.select("_row", F.explode("m").alias("_m")).select("_row", "_m.*").filter("not seed")
    more = m.join(trusted(found, docs, least, support), ["k", "v"]).groupBy("_row").agg(
        F.collect_list(F.struct("k", "s", "e", "text", F.lit(True).alias("found"), F.col("conf").alias("confidence"))).alias("_more"))
    base = F.transform(F.filter("m", lambda x: x["seed"]), lambda x: F.struct(
        x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["text"].alias("text"), F.lit(False).alias("found"), F.lit(1.0).alias("confidence")))
    joined = found.join(more, "_row", "left").withColumn("_all", F.array_sort(F.when(F.col("_more").isNull(), base).otherwise(F.concat(base, "_more"))))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform("_all", lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
                                                   x["text"].alias("text"), x["found"].alias("found"), x["confidence"].alias("confidence")))
    return joined.select("doc_id", spans.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the strict forms by kind, their digest, and all spans as text."""
    joined = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: ~x["found"])

    def of(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(of, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
