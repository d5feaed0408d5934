"""Landed pages: numbering, the short-page rule and filters that choose folders."""

import json

import pytest
from pyspark.sql import types as T

from rollcall.sources import readers

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("place", T.StringType())])


def put(folder, pages):
    folder.mkdir(parents=True)
    for i, page in enumerate(pages):
        (folder / f"p{i}.json").write_text(json.dumps(page))


def page(offset, ids):
    return {"offset": offset, "total": 99, "count": len(ids), "records": [{"id": i, "place": "x"} for i in ids]}


def test_reading_ends_with_the_first_short_page(spark, tmp_path):
    put(tmp_path / "flat", [page(0, [1, 2]), page(2, [3]), page(4, [8, 9])])
    read = lambda name: sorted(r["id"] for r in readers.read_record_pages(spark, str(tmp_path / name), RECORD, 2).collect())
    assert read("flat") == [1, 2, 3]
    put(tmp_path / "empty", [page(0, [1, 2]), page(2, []), page(4, [8, 9])])
    assert read("empty") == [1, 2]
    put(tmp_path / "full", [page(0, [1, 2]), page(2, [3, 4])])
    assert read("full") == [1, 2, 3, 4]
    put(tmp_path / "bare", [{"offset": 0, "total": 0}, page(2, [3, 4])])
    assert read("bare") == []


def test_each_folder_ends_on_its_own(spark, tmp_path):
    put(tmp_path / "site=a", [page(0, [1, 2]), page(2, [3]), page(4, [8, 9])])
    put(tmp_path / "site=b", [page(0, [5, 6]), page(2, [7])])
    rows = readers.read_record_pages(spark, str(tmp_path), RECORD, 2).collect()
    assert sorted((r["site"], r["id"]) for r in rows) == [("a", 1), ("a", 2), ("a", 3), ("b", 5), ("b", 6), ("b", 7)]


def test_landed_pages_come_back_and_filters_choose_folders(spark, tmp_path):
    rows = [(i, "hot" if i % 2 else f"p{i % 5}") for i in range(101)]  # one place holds half of the rows
    df = spark.createDataFrame(rows, RECORD)
    path = str(tmp_path / "landed")
    readers.land_pages(df, "id", 4, path, ["place"])
    back = readers.read_record_pages(spark, path, RECORD, 4)
    assert sorted((r["id"], r["place"]) for r in back.collect()) == sorted(rows)
    one = readers.read_record_pages(spark, path, RECORD, 4, {"place": "hot"})
    assert sorted(r["id"] for r in one.collect()) == [i for i, p in rows if p == "hot"]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(place" in plan and "hot" in plan
    with pytest.raises(ValueError):
        readers.read_record_pages(spark, path, RECORD, 4, {"id": 3})
    readers.land_pages(df, "id", 4, str(tmp_path / "flat"))
    pages = spark.read.json(str(tmp_path / "flat")).select("offset", "total", "count").collect()
    assert sorted(map(tuple, pages)) == [(o, 101, min(4, 101 - o)) for o in range(0, 101, 4)]
