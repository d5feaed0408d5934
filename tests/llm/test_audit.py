"""Filter audit and whitening against brute force."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import filter_audit, whitening

DOCS = "doc_id long, text string, lang string, part int, _h string, _first int, rows int"
LABELS = "doc_id long, quality int, toxic int, part string"


def naive_audit(docs, labels):
    """{(part, order, step): counts} by running every order over the rows."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs)}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(lost)
                out[part, "".join(order), step] = [
                    len(left), len(lost), sum(f in r[1] for r in mine) - len(lost), sum(r[1] == {f} for r in mine), sum(r[2] for r in lost), sum(r[3] for r in lost), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in df.collect()}


def test_audit_against_every_order(spark):
    plain = " ".join(f"w{i}" for i in range(120))
    docs = [(1, plain, "en"), (2, plain, "en"), (3, plain, None), (4, None, "en"), (5, "", ""), (6, "A B\tC\x0bd", "de"), (7, "a a a a a", "de"),
            (8, plain + " |", "en"), (None, plain, "en"), (9, " ".join(["x y"] * 80), "en"), (9, plain, "en"), (9, plain, "en"), (10, "é" * 9 + "X", "fr"),
            (11, "word " * 300_000, "fr"), (12, plain.upper(), "fr"), (13, plain + "\xa0#", "en"), (0, plain + " |", "de")]
    docs += [(100 + i, "same text # of many rows", "en") for i in range(400)]
    labels = [(1, 1, 0), (2, 1, 1), (9, 0, 0), (9, 1, 0), (None, 1, 1), (105, None, 1), (777, 1, 1)]
    d = spark.createDataFrame([(i, t, g, 1, "x", 2, 3) for i, t, g in docs], DOCS).repartition(5)
    lab = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    assert audited(filter_audit.audit(d, lab)) == naive_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert len(audited(filter_audit.audit(d, lab.limit(0)))) == 600 * 4


def test_audit_other_filters(spark):
    d = spark.createDataFrame([(1, "aa", "en"), (2, "b", "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in filter_audit.audit(d, lab, {"S": F.length("text") < 2}, "X").collect()}
    assert out == {("SX", 1): (1, 2), ("SX", 2): (1, 0), ("XS", 1): (2, 1), ("XS", 2): (1, 1)}
    with pytest.raises(ValueError):
        filter_audit.audit(d, lab, {c: F.lit(True) for c in "ABCDEFGH"}, None)


def naive_whitening(v, most=32):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in row] for row in v]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * a - b for a, b in zip(r, s)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n ** 3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    white = np.array([[a / n for a in r] for r in z]) @ axes[:, order] / np.sqrt(values[order])
    return [sum(a * a for a in r) for r in z], white, values[order] / np.trace(cov)


@pytest.mark.parametrize("d,size", [(5, 1.0), (40, 1.0), (5, 1e9)])
def test_whitening_against_brute_force(spark, d, size):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * size).tolist()
    rows = [(i, r, "x", 0) for i, r in enumerate(v)]
    odd = [(1, None, "x", 0), (2, [1.0, None] + [0.0] * (d - 2), "x", 0), (3, [float("nan")] + [0.0] * (d - 1), "x", 0),
           (4, [float("inf")] * d, "x", 0), (5, [1.0] * (d + 1), "x", 0), (6, [], "x", 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, deviation string, n int").repartition(7)
    deviation, white, share = naive_whitening(v)
    got = whitening.components(df, "vec_id", "embedding").collect()
    k = min(32, d)
    assert len(got) == 300 * k and {r["n"] for r in got} == {300}
    out = np.zeros((300, k))
    for r in got:
        out[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 1 << 63 else None)
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9
    sign = np.sign((out * white).sum(axis=0))
    assert np.abs(out * sign - white).max() < 1e-6
    assert np.abs(out.T @ out / 300 - np.eye(k)).max() < 1e-6 and {r["identity_error"] < 1e-6 for r in got} == {True}


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.components(one, "vec_id", "embedding").count() == 0
    assert whitening.components(one.limit(0), "vec_id", "embedding").count() == 0
    flat = spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.components(flat, "vec_id", "embedding").collect()
    assert len(got) == 9 and got[0]["component"] == 1 and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
