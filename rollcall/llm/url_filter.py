"""URL filter: explicit rules first, learned path templates for the rest.

Every host has a tree of path templates.  A segment that holds a digit, or
whose parent has more than ``max_branch`` different children, is a variable
and becomes ``*``.  Templates below a common parent whose labelled share of
bad pages does not differ significantly from that of their siblings are
merged, so they share their counts.  The share of bad pages of a (merged)
template is smoothed towards the share of the same template on all hosts, and
that towards the share over all labelled pages; a template above ``reject``
is blocked.

DataFrame functions only; all statistics are grouped aggregations with
map-side combine, so a host that holds a third of all pages is never gathered
in one task.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path (template ``/``); repeated urls get equal verdicts, whatever their
page ids, repeated and null ids included; an empty table
gives an empty result; without any labelled page the share is the prior
``0.5 * pseudo / pseudo`` of the smoothing, which is not above ``reject``, so
everything without a rule is allowed.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.spread import small
from rollcall.llm.common import ascii_lower, hold

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select("page_id", ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"),
                        F.regexp_extract(url, URL, 2).alias("path"))


def best_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Longest fitting rule as a struct ``(size, host_size, rule, action)``; null if none fits.

    ``rules`` holds (action, host, path).  A rule fits its host and all
    subdomains if the path starts with the rule's path.
    """
    fits = [F.when((F.col("host").eqNullSafe(h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(len(h)).alias("host_size"),
                            F.lit(h + p).alias("rule"), F.lit(action).alias("action")))
            for action, h, p in rules]
    if not fits:
        return F.lit(None).cast("struct<size:int,host_size:int,rule:string,action:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def path_templates(parts: DataFrame, max_branch: int = 32) -> DataFrame:
    """``host, path, template, parent`` of every distinct host and path.

    ``template`` has variable segments as ``*``, ``parent`` its last fixed one as well.
    """
    parts = parts.select("host", "path").distinct()
    segment = parts.select("host", "path", F.posexplode(
        F.filter(F.split("path", "/"), lambda s: s != "")).alias("depth", "seg"))
    fixed = F.when(F.col("seg").rlike("[0-9]"), F.lit("*")).otherwise(F.col("seg"))
    before = F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.element_at(F.filter(F.split("path", "/"), lambda s: s != ""), F.greatest(F.col("depth"), F.lit(1))))
    segment = segment.select("host", "path", "depth", fixed.alias("seg"),
                             F.when(before.rlike("[0-9]"), F.lit("*")).otherwise(before).alias("before"))
    wide = (segment.filter("seg <> '*'").select("host", "depth", "before", "seg").distinct()
            .groupBy("host", "depth", "before").agg(F.count(F.lit(1)).alias("children"))
            .filter(F.col("children") > max_branch)
            .select(F.col("host").alias("_h"), F.col("depth").alias("_d"), F.col("before").alias("_b"), F.lit(True).alias("variable")))
    # broadcast only when proven small; a larger table is joined by shuffling
    token = segment.join(small(wide), (F.col("host") == F.col("_h")) & (F.col("depth") == F.col("_d"))
                         & (F.col("before") == F.col("_b")), "left")
    token = token.select("host", "path", "depth", F.when(F.col("variable"), F.lit("*")).otherwise(F.col("seg")).alias("seg"))
    lists = token.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("depth", "seg"))).alias("s"))
    seg = F.transform("s", lambda x: x["seg"])
    last = F.array_max(F.transform("s", lambda x: F.when(x["seg"] != "*", x["depth"])))
    up = F.transform("s", lambda x: F.when(x["depth"] == F.col("last"), F.lit("*")).otherwise(x["seg"]))
    lists = lists.withColumn("last", last)
    return lists.select("host", "path", F.concat(F.lit("/"), F.array_join(seg, "/")).alias("template"),
                        F.concat(F.lit("/"), F.array_join(up, "/")).alias("parent"))


def template_shares(labelled: DataFrame, pseudo: float = 4.0, similar_z: float = 1.96) -> DataFrame:
    """Smoothed share of bad pages per (host, template) from ``host, template, parent, bad`` (bad null: unlabelled)."""
    one = labelled.groupBy("host", "parent", "template").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
    pool = one.groupBy("host", "parent").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    one = one.join(pool.select(F.col("host").alias("_h"), F.col("parent").alias("_p"), "pn", "pb"),
                   (F.col("host") == F.col("_h")) & (F.col("parent") == F.col("_p"))).drop("_h", "_p")
    # similar to its siblings: (b/n - P)^2 * n <= z^2 * P * (1 - P), written without division
    gap = F.col("b") * F.col("pn") - F.col("pb") * F.col("n")
    same = (F.col("n") == 0) | (gap.cast("double") * gap <= similar_z * similar_z
                                * F.col("n").cast("double") * F.col("pb") * (F.col("pn") - F.col("pb")))
    one = one.withColumn("branch", F.when(same, F.col("parent")).otherwise(F.col("template")))
    merged = one.groupBy("host", "branch").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    across = one.groupBy("template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    whole = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gn"), F.coalesce(F.sum("b"), F.lit(0)).alias("gb"))
    joined = (one.join(merged.select(F.col("host").alias("_h"), F.col("branch").alias("_b"), "mn", "mb"),
                       (F.col("host") == F.col("_h")) & (F.col("branch") == F.col("_b"))).drop("_h", "_b")
              .join(across.withColumnRenamed("template", "_t"), F.col("template") == F.col("_t")).drop("_t")
              .crossJoin(F.broadcast(whole)))
    over_all = (F.col("gb") + pseudo * 0.5) / (F.col("gn") + pseudo)
    over_hosts = (F.col("tb") + pseudo * over_all) / (F.col("tn") + pseudo)
    return joined.select("host", "template", ((F.col("mb") + pseudo * over_hosts) / (F.col("mn") + pseudo)).alias("share"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labels: DataFrame | None = None,
               max_branch: int = 32, pseudo: float = 4.0, similar_z: float = 1.96, reject: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, share`` for every page.

    ``labels`` (page_id, bad 0/1) are further labelled pages; the pages that a
    rule decides are labelled by it.  Every row is judged by its own url, so
    rows with one page id, or with none, get the verdicts of their urls.
    """
    parts = with_parts(pages)
    ruled = parts.withColumn("r", best_rule(rules))
    shapes = path_templates(parts, max_branch).withColumnsRenamed({"host": "_h", "path": "_p"})
    pages_in = ruled.join(shapes, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
    root = F.lit("/")
    pages_in = pages_in.withColumns({"template": F.coalesce("template", root), "parent": F.coalesce("parent", root)})
    by_rule = F.when(F.col("r.action") == "block", 1).when(F.col("r.action") == "allow", 0)
    if labels is None:
        marked = pages_in.withColumn("bad", by_rule)
    else:
        given = labels.groupBy(F.col("page_id").alias("_lid")).agg(F.max("bad").alias("given"))
        marked = (pages_in.join(given, F.col("page_id") == F.col("_lid"), "left")
                  .withColumn("bad", F.coalesce(by_rule, F.col("given"))))
    marked = hold(marked, "pages")
    pages_in = marked
    shares = template_shares(marked.select("host", "template", "parent", "bad"), pseudo, similar_z)
    out = pages_in.join(shares.select(F.col("host").alias("_h"), F.col("template").alias("_t"), "share"),
                        (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    learned = F.when(F.col("share") > reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                      F.coalesce(F.col("r.action"), learned).alias("verdict"), "template", "share")
