"""Learned operators on held-out rows, neighbours against brute force, URLs against literal cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import nn_descent, quality, toxicity, url_filter
from rollcall.llm.queries import URL_RULES

DATA = "/root/testdata/sf0.01"


def test_url_rules(spark):
    urls = ["https://A.Example.ORG/es/1", "http://example.org/en/17?x", "http://x.org", "http://b.com/fr/9#t", "http://b.com/de/", "http://b.net/de/1",
            "no scheme", None, "http://example.organic/es/", "://org/", "ftp://x.y/z://w"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, template string")
    rows = {r["page_id"]: r for r in url_filter.url_filter(pages, URL_RULES).collect()}
    assert [(rows[i]["host"], rows[i]["rule"], rows[i]["verdict"]) for i in (0, 1, 3, 4)] == [
        ("a.example.org", "example.org/es/", "block"), ("example.org", "example.org/en/1", "block"), ("b.com", "com/fr/", "allow"), ("b.com", "com/de/", "block")]
    assert (rows[2]["host"], rows[2]["path"], rows[2]["rule"]) == ("x.org", "", None)
    assert all((rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == ("", "", None) for i in (6, 7))
    assert rows[8]["rule"] is None and rows[9]["rule"] == "org/" and rows[10]["path"] == "/z://w"
    assert url_filter.url_filter(pages.limit(0), URL_RULES).count() == 0


def test_url_templates(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/{'junk' if i % 2 else 'good'}/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "page_id long, bad int")
    rows = url_filter.url_filter(pages, [], labels).collect()
    assert {(r["template"], r["verdict"]) for r in rows} == {("/junk/*", "block"), ("/good/*", "allow")}


def test_url_repeated_and_null_ids(spark):
    urls = [f"http://h.net/{'junk' if i % 2 else 'good'}/{i}" for i in range(40)]
    long = "http://h.net/junk" + "/x7" * 3000
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[1]), (None, urls[3]), (None, urls[2]), (7, long)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 20)], "page_id long, bad int")
    rows = url_filter.url_filter(pages, [], labels).collect()
    assert len(rows) == len(urls) + 4
    assert all(r["verdict"] == ("block" if r["path"].startswith("/junk/") else "allow") for r in rows if len(r["path"]) < 99)
    assert [r["template"] for r in rows if len(r["path"]) > 99] == ["/junk" + "/*" * 3000]


def brute(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors])
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            score = x @ np.array(v)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_recall(spark):
    rows = nn_descent.nearest(spark.read.parquet(f"{DATA}/embeddings.parquet")).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, hits = brute(vectors, 20), 0
    for q, near in want.items():
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        hits += len({r["vec_id"] for r in own} & {i for i, _ in near})
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("folder,spread", [("sf0.1", 0.2), ("sf0.1", 0.5), ("sf0.1", 0.0)])
def test_neighbours_recall_whatever_the_lengths(spark, folder, spread):
    frame = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.array(frame["embedding"].tolist()) * np.exp(spread * np.random.default_rng(3).standard_normal(len(frame)))[:, None]
    ids = frame["vec_id"].to_numpy()
    rows = nn_descent.nearest(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>")).collect()
    own = {}
    for r in rows:
        own.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(own[ids[q]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    print("recall", folder, spread, np.mean(recall))
    assert np.mean(recall) >= 0.9


def test_neighbours_edges(spark):
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(12)] + [(40 + i, [3.0, 0.0, 0.0, 0.0]) for i in range(30)]
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [float("inf"), 0.0, 0.0, 0.0]), (200, [1.0])]
    frame = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in good + bad] + [(None, [1.0] * 4, "", 0.0)], "vec_id long, embedding array<double>, id string, sim double")
    rows = nn_descent.nearest(frame).collect()
    want = brute(good, 20)
    assert {r["query_id"] for r in rows} == set(want)
    for q, near in want.items():
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == [i for i, _ in near]
        assert [r["score"] for r in own] == pytest.approx([s for _, s in near])
    few = nn_descent.nearest(frame.filter("vec_id in (0, 1, 2, 100)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert nn_descent.nearest(frame.limit(0)).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(np.array([len(t) for t, _ in vectors]), *(np.concatenate(c) for c in zip(*vectors)), 40, block=16)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 300, 7):
        near, score = index.nearest(*vectors[i], 10, skip=i)
        full = dense @ dense[i]
        full[i] = 0
        order = [j for j in np.lexsort((np.arange(300), -full)) if full[j] > 0][:10]
        assert score == pytest.approx(full[order]) and set(near.tolist()) == set(order) or score == pytest.approx(full[order])


@pytest.mark.parametrize("head,block", [(0, 7), (5, 16), (40, 512)])
def test_search_of_many_is_exact(head, block):
    """Frequent terms by matrix products, others by postings, equal vectors as one: the same neighbours as brute force, ties by number."""
    rng = np.random.default_rng(3)
    dense = np.zeros((600, 40))
    for i in range(600):
        t = rng.choice(40, rng.integers(1, 9), replace=False)
        dense[i, t] = rng.integers(1, 4, len(t))
    dense[200:260] = dense[7]
    dense /= np.sqrt((dense * dense).sum(1))[:, None]
    row, term = np.nonzero(dense)
    sizes = np.bincount(row, minlength=600)
    index = toxicity.BlockMaxIndex(sizes, term, dense[row, term], 40, block=block, head=head)
    assert index.head.shape[1] == head
    for i, (near, score) in enumerate(index.search(sizes, term, dense[row, term], 10, np.arange(600))):
        full = (dense * dense[i]).sum(1)
        assert len(near) == 10 and i not in near
        assert score == pytest.approx(full[near]) and score == pytest.approx(np.sort(np.delete(full, i))[::-1][:10])
    near, _ = index.nearest(term[row == 7], dense[7][dense[7] > 0], 10, skip=7)
    assert near.tolist() == list(range(200, 210))


@pytest.mark.parametrize("text", [None, "", "Don't stop\u00a0NOW, x\u00b2 na\u00efve\u2014end a_b 12ab34 \u2167 a a\x1cA", "\u0130x, \u00df\u3000\u4e2d\u6587"])
def test_word_counts(text):
    words = toxicity.WORD.findall((text or "").lower())
    assert toxicity.word_counts(text) == {w: words.count(w) for w in words}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.06 * len(clean)


def small(spark, rows):
    return spark.createDataFrame([(i, t, "s", "l", "clash", "clash") for i, t in rows],
                                 "doc_id long, text string, source string, lang string, label string, score string")


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "some text"), (4, "word " * 20000), (5, "| | ### $$$ !!!")]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (4, None), (None, 1), (5, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(small(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in toxicity.toxicity(small(spark, ODD), labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(small(spark, []), labels).count() == 0


def test_toxicity_knows_every_word(spark):
    clean = [(i, f"plain c{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} talk about gardens") for i in range(60)]
    toxic = [(100, "vexum talk about gardens"), (101, "drolk plain")]
    asked = [(200, "you vexum"), (201, "drolk there"), (202, "plain cak talk"), (203, "never seen words")]
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(small(spark, clean + toxic + asked), labels, held_out=9).collect()}
    # words of a single toxic example lead to it, and words of clean text to clean examples
    assert rows[200]["evidence"] == [100] and rows[201]["evidence"] == [101]
    assert rows[202]["evidence"] == [] and rows[202]["score"] < min(rows[200]["score"], rows[201]["score"])
    assert rows[203]["evidence"] == [] and rows[203]["score"] < 0.3


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def test_quality_edges(spark):
    frame = small(spark, ODD).withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(frame, labels, held_out=None).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.keep_good(frame, labels, held_out=None).columns == frame.columns
    assert quality.quality(frame, labels.limit(0)).filter("kept").count() == len(ODD)
    assert quality.quality(frame.limit(0), labels).count() == 0
