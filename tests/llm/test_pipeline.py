"""Every stage of the corpus pipeline against a plain version of what it decides."""

import zlib

import numpy as np
import public_tokenizers as vocab
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import naive_components, naive_repeats  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "packing"
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    left = {r["doc_id"] for r in kept["quality"]}
    every = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(good & left) >= 0.98 * len(good & every)

    best = {}
    for r in kept["quality"]:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        best[text] = min(best.get(text, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in kept["exact_dedup"]} == set(best.values())

    near = naive_components([(r["doc_id"], r["text"]) for r in kept["exact_dedup"]], 5, 80)
    assert {r["doc_id"] for r in kept["near_dedup"]} == {root for _, _, root in near}

    assert len(kept["substring_dedup"]) == len(kept["near_dedup"])
    lib = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    want = []
    for r in kept["substring_dedup"]:
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], p, zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["packing"]) == sorted(want)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
