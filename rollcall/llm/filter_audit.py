"""Interaction audit of filters: what every order of a set of filters removes, step by step.

* Each filter is a failure condition on one row.  ``failures`` evaluates all of
  them in one scan of the documents, on whole texts, with built-in functions.
* The copy filter is an existential self-join: a row fails when the table holds
  a row with the same text hash, the same whole text and a smaller ``doc_id``.
  As only the smallest id of a text can decide that, the inner side is folded to
  it (inside the tasks first) and keeps texts that occur twice or more.  Texts
  that hold more than a thousandth of all rows, a thousand of them at most, are
  dealt over as many slices as they hold thousandths, so copies of one text
  never meet in one task.
* The ids that fail are united with the failures of the other filters; rows
  come down to counts per (part, combination of failures, labels), at most a few
  hundred per part, from which every order is worked out.

Defined results: a null text counts as empty and a null ``lang`` as the part
``''``; a row without ``doc_id`` neither fails the copy filter nor makes others
fail it; rows with one ``doc_id`` are judged one by one and share its labels (the
highest of several); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.llm.common import UPPER, hold

SPACE = "[\\x20\\x09-\\x0D]+"
COPY = "E"
ROW = ["doc_id", "part", "_h", "_g"]
MOST_FILTERS = 7


def standard_filters() -> dict[str, Column]:
    """Failure conditions on ``text``: few words, few different words, many capitals, symbols."""
    text = F.col("text")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and a 128-bit digest that tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g"))


def copies(rows: DataFrame) -> DataFrame:
    """Rows whose whole text also belongs to a smaller ``doc_id``."""
    first = hold(rows.groupBy("_h", "text").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "audit-first")
    total = max(1, rows.count())
    slices = F.floor(F.max("_n") * 1000 / total).cast("int") + 1
    hot = F.broadcast(first.filter(F.col("_n") * 1000 > total).groupBy("_h").agg(slices.alias("_slices")))
    left = rows.join(hot, "_h", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("_slices", F.lit(1))))
    right = first.join(hot, "_h", "left").select(F.col("_h").alias("_rh"), F.col("text").alias("_rtext"), "_first",
                                                 F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)).alias("_rsalt"))
    same = (F.col("_h") == F.col("_rh")) & (F.col("_salt") == F.col("_rsalt")) & (F.col("text") == F.col("_rtext"))
    return left.join(right, same & (F.col("_first") < F.col("doc_id")), "left_semi").select(*ROW)


def failures(docs: DataFrame, filters: Mapping[str, Column] | None = None, copy_filter: str | None = COPY) -> DataFrame:
    """(doc_id, part, digest, mask, rows): bit i of ``mask`` is set where the i-th filter (by name) fails."""
    filters = standard_filters() if filters is None else dict(filters)
    bit = {name: 1 << i for i, name in enumerate(names(filters, copy_filter))}
    rows = _rows(docs)
    mask = sum((F.when(cond, bit[name]).otherwise(0) for name, cond in filters.items()), F.lit(0))
    found = rows.select(*ROW, mask.alias("mask"), F.lit(1).cast("bigint").alias("rows"))
    if copy_filter:
        found = found.unionByName(copies(rows).select(*ROW, F.lit(bit[copy_filter]).alias("mask"), F.lit(0).cast("bigint").alias("rows")))
    return found.groupBy(*ROW).agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows"))


def names(filters: Mapping[str, Column], copy_filter: str | None) -> list[str]:
    found = sorted([*filters, *([copy_filter] if copy_filter else [])])
    if len(set(found)) < len(found) or len(found) > MOST_FILTERS or any(len(f) != 1 for f in found):
        raise ValueError(f"at most {MOST_FILTERS} different filters named by one letter")
    return found


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per part, combination of failures, and labels good and toxic."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = failed.join(marks, "doc_id", "left")
    return known.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("rows").alias("rows"))


def interactions(combined: DataFrame, letters: list[str]) -> DataFrame:
    """One row per part, order of all filters and step."""
    steps = []
    for order in permutations(letters):
        seen = 0
        for i, name in enumerate(order):
            bit = 1 << letters.index(name)
            steps.append(f"{''.join(order)}:{i + 1}:{name}:{seen}:{bit}")
            seen |= bit
    # one literal string: hundreds of struct literals would be hundreds of expressions
    at = F.explode(F.split(F.lit(",".join(steps)), ",")).alias("_at")
    wide = combined.select("*", at).withColumn("_s", F.split("_at", ":")).select(
        "part", "mask", "good", "toxic", "rows", F.col("_s")[0].alias("filter_order"), F.col("_s")[1].cast("int").alias("step"),
        F.col("_s")[2].alias("_name"), F.col("_s")[3].cast("int").alias("_seen"), F.col("_s")[4].cast("int").alias("_bit"))
    fails = F.col("mask").bitwiseAND(F.col("_bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("_seen")) != 0

    def count(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, F.col("rows")).otherwise(F.lit(0).cast("bigint"))).alias(name)

    out = wide.groupBy("part", "filter_order", "step", "_name").agg(
        count(~fails & ~gone, "kept"), count(fails & ~gone, "removed"), count(fails & gone, "redundant"),
        count(F.col("mask") == F.col("_bit"), "unique_fails"), count(fails & ~gone & F.col("good"), "good_lost"),
        count(fails & ~gone & F.col("toxic"), "toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "_name"))).drop("_name")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copy_filter: str | None = COPY) -> DataFrame:
    """kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley per part, order and step."""
    filters = standard_filters() if filters is None else filters
    return interactions(hold(combinations(failures(docs, filters, copy_filter), labels), "audit"), names(filters, copy_filter))
