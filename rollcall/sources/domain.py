"""Domain facts and dimensions as views over the star-schema tables.

Every view uses integer arithmetic only.  ``VIEW_SQL`` holds the same views for
the check engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Domain:
    """Lazy access to the tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def regions(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        k = F.col("n_nationkey")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                 .select(F.col("n_name").alias("state"), F.col("r_name").alias("zone"),
                         (8 + (k * 7) % 29).cast("double").alias("lat"),
                         (69 + (k * 11) % 28).cast("double").alias("lon"),
                         ((10 + (k * 7919) % 97) * 100000).cast("bigint").alias("population")))

    def enrolment(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        t = F.col("t")
        kids = F.expr("t * (5 + o_orderkey % 11) div 100")
        youth = F.expr("t * (15 + o_orderkey % 17) div 100")
        return (o.select("o_orderkey", "o_custkey", "o_orderdate",
                         F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("t"))
                 .join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
                 .join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
                 .select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("date").alias("date"),
                         F.col("n_name").alias("state"),
                         F.concat("n_name", F.lit("_"), "c_mktsegment").alias("district"),
                         F.col("c_custkey").cast("string").alias("pincode"),
                         kids.alias("age_0_5"), youth.alias("age_5_17"), (t - kids - youth).alias("age_18_greater")))

    def gaps(self) -> DataFrame:
        """Enrolment with missing cells at fixed positions."""
        k = F.col("record_id")
        return (self.enrolment()
                .withColumn("age_0_5", F.when(k % 10 != 3, F.col("age_0_5")))
                .withColumn("age_5_17", F.when(k % 13 != 5, F.col("age_5_17")))
                .withColumn("district", F.when(k % 17 != 2, F.col("district"))))

    def _updates(self, status: str, prefix: str) -> DataFrame:
        li, s, n = self.table("lineitem"), self.table("supplier"), self.table("nation")
        young = F.expr("q * (10 + l_linenumber) div 40")
        return (li.filter(F.col("l_linestatus") == status)
                  .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                          F.col("l_quantity").cast("bigint").alias("q"))
                  .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(n.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
                  .select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("bigint").alias("line_no"),
                          F.col("l_shipdate").cast("date").alias("date"), F.col("n_name").alias("state"),
                          F.concat("n_name", F.lit("_C"), (F.col("l_partkey") % 10).cast("string")).alias("center_id"),
                          F.col("l_suppkey").alias("operator_id"),
                          young.alias(f"{prefix}_age_5_17"), (F.col("q") - young).alias(f"{prefix}_age_17_")))

    def demographic(self) -> DataFrame:
        return self._updates("O", "demo")

    def biometric(self) -> DataFrame:
        return self._updates("F", "bio")

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def districts(self) -> DataFrame:
        """One row per district: place, population, this and the previous year's enrolment."""
        e = spread.with_totals(self.enrolment(), F.max("date").alias("_last"))
        total = F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")
        # the last year that is complete, and the one before
        year = F.year("date") - (F.year(F.date_add("_last", 1)) - 1)
        agg = e.groupBy("state", "district").agg(
            F.sum(total).alias("enrolments"),
            F.sum(F.when(year == 0, total).otherwise(0)).alias("current"),
            F.sum(F.when(year == -1, total).otherwise(0)).alias("previous"))
        seg = (F.instr(F.lit("ABFHM"), F.substring(F.element_at(F.split("district", "_"), -1), 1, 1)) - 1)
        return (agg.join(self.regions(), "state").withColumn("_s", seg)
                   .select("state", "district", "zone",
                           (F.col("lat") + (F.col("_s") - 2) * 0.5).alias("lat"),
                           (F.col("lon") + (F.col("_s") % 3 - 1) * 0.5).alias("lon"),
                           F.expr("population div 5 + _s * 1000").alias("population"),
                           "enrolments", "current", "previous"))

    def finished_months(self) -> DataFrame:
        """Enrolment without the last month, unless that one is complete."""
        e = spread.with_totals(self.enrolment(), F.max("date").alias("_last"))
        end = F.when(F.col("_last") < F.last_day("_last"), F.trunc("_last", "month")).otherwise(F.date_add("_last", 1))
        return e.filter(F.col("date") < end).drop("_last")

    def months(self) -> DataFrame:
        """State by month series of enrolment totals; the unfinished last month is left out."""
        total = F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")
        return (self.finished_months().groupBy("state", F.trunc("date", "month").alias("month"))
                 .agg(F.sum(total).alias("value")))


def _updates_sql(status: str, prefix: str) -> str:
    return f"""SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, CAST(l_shipdate AS DATE) AS date,
  n_name AS state, concat(n_name,'_C',CAST(l_partkey%10 AS VARCHAR)) AS center_id, l_suppkey AS operator_id,
  q*(10+l_linenumber)//40 AS {prefix}_age_5_17, q-q*(10+l_linenumber)//40 AS {prefix}_age_17_
  FROM (SELECT *, CAST(l_quantity AS BIGINT) q FROM lineitem WHERE l_linestatus='{status}') l
  JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey"""


VIEW_SQL = {
    "regions": """SELECT n_name AS state, r_name AS zone, CAST(8+(n_nationkey*7)%29 AS DOUBLE) AS lat,
  CAST(69+(n_nationkey*11)%28 AS DOUBLE) AS lon, CAST((10+(n_nationkey*7919)%97)*100000 AS BIGINT) AS population
  FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "enrol": """SELECT o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS date, n_name AS state,
  concat(n_name,'_',c_mktsegment) AS district, CAST(c_custkey AS VARCHAR) AS pincode,
  t*(5+o_orderkey%11)//100 AS age_0_5, t*(15+o_orderkey%17)//100 AS age_5_17,
  t-t*(5+o_orderkey%11)//100-t*(15+o_orderkey%17)//100 AS age_18_greater
  FROM (SELECT *, CAST(floor(o_totalprice/100) AS BIGINT) t FROM orders) o
  JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey""",
    "gaps": """SELECT record_id, date, state, CASE WHEN record_id%17<>2 THEN district END AS district, pincode,
  CASE WHEN record_id%10<>3 THEN age_0_5 END AS age_0_5, CASE WHEN record_id%13<>5 THEN age_5_17 END AS age_5_17,
  age_18_greater FROM enrol""",
    "demo": _updates_sql("O", "demo"),
    "bio": _updates_sql("F", "bio"),
    "districts": """SELECT d.state, d.district, zone, lat+(s-2)*0.5e0 AS lat, lon+(s%3-1)*0.5e0 AS lon,
  population//5+s*1000 AS population, enrolments, current, previous
  FROM (SELECT state, district, CAST(sum(age_0_5+age_5_17+age_18_greater) AS BIGINT) AS enrolments,
    CAST(sum(CASE WHEN year(date)=year(last+1)-1 THEN age_0_5+age_5_17+age_18_greater ELSE 0 END) AS BIGINT) AS current,
    CAST(sum(CASE WHEN year(date)=year(last+1)-2 THEN age_0_5+age_5_17+age_18_greater ELSE 0 END) AS BIGINT) AS previous,
    CAST(instr('ABFHM', substr(split_part(district,'_',-1),1,1))-1 AS BIGINT) AS s
    FROM enrol, (SELECT max(date) AS last FROM enrol) GROUP BY state, district) d JOIN regions r ON d.state=r.state""",
    "months": """SELECT state, CAST(date_trunc('month', date) AS DATE) AS month,
  CAST(sum(age_0_5+age_5_17+age_18_greater) AS BIGINT) AS value
  FROM enrol WHERE date < (SELECT CASE WHEN max(date) < last_day(max(date)) THEN CAST(date_trunc('month', max(date)) AS DATE) ELSE max(date)+1 END FROM enrol) GROUP BY 1, 2""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it mentions (directly or through other views)."""
    views = {**VIEW_SQL, **(extra or {})}
    needed: list[str] = []

    def need(text: str) -> None:
        for name, sql in views.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.IGNORECASE):
                need(sql)
                if name not in needed:
                    needed.append(name)

    need(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in needed)
    head = "WITH "
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ctes + ",\n" + body.lstrip()[15:]
    if body.lstrip().upper().startswith("WITH "):
        return head + ctes + ",\n" + body.lstrip()[5:]
    return head + ctes + "\n" + body
