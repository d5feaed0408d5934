"""Sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators import clean
from rollcall.plans.registry import query, rounded
from rollcall.sources import readers
from rollcall.sources.domain import TABLES, Domain

RECORD = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("state", T.StringType()),
                       T.StructField("age_0_5", T.LongType())])
PAGE = 500


def landed(d: Domain) -> str:
    """The enrolment records as page files, filed by state."""
    path = readers.work_folder(d.spark, "pages")
    readers.land_pages(d.enrolment().select("record_id", "state", "age_0_5"), "record_id", PAGE, path, ["state"])
    return path


@query("scan_records", "SELECT record_id, state, age_0_5 FROM enrol")
def scan_records(d: Domain):
    """Every record of the landed pages of all states, each state ending with its first page that is not full."""
    return readers.read_record_pages(d.spark, landed(d), RECORD, PAGE)


@query("scan_pages_filtered", "SELECT record_id, state, age_0_5 FROM enrol WHERE state='NATION_6'")
def scan_pages_filtered(d: Domain):
    """The records of one state: only the folder of its pages is read."""
    return readers.read_record_pages(d.spark, landed(d), RECORD, PAGE, {"state": "NATION_6"})


@query("scan_filtered", "SELECT * FROM enrol WHERE state='NATION_6' ORDER BY record_id LIMIT 100 OFFSET 20")
def scan_filtered(d: Domain):
    return readers.scan_filtered(d.enrolment(), {"state": "NATION_6"}, "record_id", limit=100, offset=20)


@query("scan_csv_typed", """SELECT record_id, state, coalesce(age_0_5, 0) AS age_0_5, CAST(age_5_17 AS DOUBLE) AS age_5_17 FROM gaps""")
def scan_csv_typed(d: Domain):
    """Typed CSV files with a header and blank cells, written from the given rows and read back."""
    schema = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("state", T.StringType()),
                           T.StructField("age_0_5", T.LongType()), T.StructField("age_5_17", T.DoubleType())])
    path = readers.work_folder(d.spark, "typed-csv")
    readers.write_csv(d.gaps().select("record_id", "state", "age_0_5", "age_5_17"), path)
    return readers.read_typed_csv(d.spark, path, schema, zero=["age_0_5"])


@query("union_sources", """SELECT source, state, count(*) AS n, CAST(sum(demo_age_5_17) AS BIGINT) AS demo_young,
 CAST(sum(bio_age_5_17) AS BIGINT) AS bio_young FROM (
 SELECT 'demographic' AS source, state, demo_age_5_17, NULL AS bio_age_5_17 FROM demo
 UNION ALL SELECT 'biometric', state, NULL, bio_age_5_17 FROM bio) GROUP BY 1, 2""")
def union_sources(d: Domain):
    u = readers.union_sources({"demographic": d.demographic(), "biometric": d.biometric()})
    return u.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("demo_age_5_17").alias("demo_young"),
                                            F.sum("bio_age_5_17").alias("bio_young"))


_PROFILE = [("record_id", "bigint"), ("date", "date"), ("state", "string"), ("district", "string"),
            ("pincode", "string"), ("age_0_5", "bigint"), ("age_5_17", "bigint"), ("age_18_greater", "bigint")]


@query("dataset_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS filled,
 (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY record_id) FROM (SELECT * FROM gaps ORDER BY record_id LIMIT 3)
  WHERE {c} IS NOT NULL) AS samples, count(*) AS row_count FROM gaps""" for c, t in _PROFILE))
def dataset_profile(d: Domain):
    return readers.dataset_profile(d.gaps(), "record_id")


_COLS = {"orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
         "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
         "events": "event_id,ts,user_id,event_type,value,props", "labels": "doc_id,quality,toxic",
         "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
                     "l_returnflag,l_linestatus,l_shipdate",
         "nation": "n_nationkey,n_name,n_regionkey", "region": "r_regionkey,r_name",
         "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
         "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
         "documents": "doc_id,text,lang,source,n_chars", "embeddings": "vec_id,embedding,label",
         "pages": "page_id,url,html", "benchmark": "item_id,text", "conversations": "conv_id,turn,role,text"}
_SUIT = "+".join(f"(CASE WHEN regexp_matches(fields, '{'|'.join(w)}') THEN {s}e0 ELSE 0e0 END)"
                 for w, s in readers.SUITABILITY)


@query("dataset_suitability", f"SELECT table_name, fields, row_count, round(least({_SUIT}, 1e0), 6) AS score FROM ("
       + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS fields, count(*) AS row_count FROM {t}"
                            for t, c in _COLS.items()) + ")")
def dataset_suitability(d: Domain):
    return rounded(readers.dataset_suitability({t: d.table(t) for t in TABLES}))


@query("page_rows", "SELECT record_id, state, district FROM enrol ORDER BY state, record_id LIMIT 50 OFFSET 100")
def page_rows(d: Domain):
    return readers.page_rows(d.enrolment().select("record_id", "state", "district"), ["state", "record_id"], 50, 100)


@query("sink_csv", """SELECT upper(substr(sha256(concat_ws('_', state, CAST(record_id AS VARCHAR))), 1, 12)) AS masked_id, state,
 age_0_5+age_5_17+age_18_greater AS total FROM enrol ORDER BY total DESC, record_id LIMIT 200""")
def sink_csv(d: Domain):
    """Top-N masked export, written and read back."""
    e = d.enrolment().withColumn("total", F.expr("age_0_5+age_5_17+age_18_greater"))
    top = e.orderBy(F.desc("total"), "record_id").limit(200)
    out = top.select(clean.mask_id("state", F.col("record_id").cast("string")).alias("masked_id"), "state", "total")
    path = readers.work_folder(d.spark, "export-csv")
    readers.write_csv(out, path)
    return readers.read_typed_csv(d.spark, path, out.schema)


@query("sink_json", """SELECT 'Feature' AS type, 'Point' AS kind, lon, lat, district, enrolments FROM districts""")
def sink_json(d: Domain):
    """District points as GeoJSON features, written as JSON lines and read back."""
    feats = d.districts().select(readers.feature(F.col("lon"), F.col("lat"), district=F.col("district"),
                                                 enrolments=F.col("enrolments")).alias("value"))
    path = readers.work_folder(d.spark, "export-geo")
    feats.write.text(path)
    back = d.spark.read.schema("type string, geometry struct<type:string,coordinates:array<double>>, "
                               "properties struct<district:string,enrolments:bigint>").json(path)
    return back.select("type", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates")[0].alias("lon"),
                       F.col("geometry.coordinates")[1].alias("lat"), "properties.district", "properties.enrolments")
