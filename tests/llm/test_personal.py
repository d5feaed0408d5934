"""Personal data: strict forms against plain regular expressions, discovery on planted contexts."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollcall.llm import personal_data as pd_

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def naive(text):
    """{kind: [(start, end)]} by the forms as they are written down."""
    out = {}
    for kind, form in FORMS.items():
        hits = []
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            hits.append(m.span())
        out[kind] = hits
    return out


def base_text(text):
    return ",".join(f"{k}:{s}:{e}" for k, hits in naive(text).items() for s, e in hits)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1205.@+- ()_%é\n", max_size=40))
def test_strict_forms(text):
    want = [(i, s, e) for i, hits in enumerate(naive(text).values()) for s, e in hits]
    base, loose = pd_.scan(text)
    assert base == want
    spans = sorted((s, e) for _, s, e in loose)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert not any(s < b and a < e for _, a, b in base for s, e in spans)


def test_strict_forms_in_long_runs():
    text = " ".join(["+1 (377) 555-0271", "4111 1111-11111111", "1.2.3.4.5.6.7.8", "1.2.3.256", "0000000255.0.0.1", "9" * 4000 + ".1.1.1", "a@b.c_d@e.f", "@a.b",
                     "x@@y.z", "4" * 60])
    assert [(pd_.KINDS[k], s, e) for k, s, e in pd_.scan(text)[0]] == [(k, s, e) for k, hits in naive(text).items() for s, e in hits]
    long = "a" * 400_000 + " " + "1" * 400_000 + " " + "1." * 200_000 + " " + "(" * 300_000 + " me@x.org " + "@" * 200_000 + ":" * 300_000
    assert [pd_.KINDS[k] for k, _, _ in pd_.scan(long)[0] if k != pd_.IP] == ["email"]


def planted(rng):
    """Documents whose slots behind 'mailbox' and 'ring' hold seeds and identifiers that the strict forms miss."""
    words = "amber birch cedar delta ember flint grove haven inlet jetty knoll larch maple north ocean".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = []
    for i in range(40):
        docs.append(f"{said(9)} mailbox user{i}@host{i}.example.org {said(5)} ring +1 (212) 555-{1000 + i} {said(4)}")
    docs += [f"{said(9)} mailbox hidden{i}@intranet {said(4)}" for i in range(4)]
    docs += [f"{said(3)} ring 555-88-{3000 + i} {said(3)}" for i in range(4)]
    docs += [f"{said(3)} amber 777-66-{4000 + i} {said(3)} birch lost{i}@nowhere {said(2)}" for i in range(4)]  # everyday words prove nothing
    docs += [f"{said(3)} elsewhere hidden1@intranet {said(3)}", f"{said(2)} 1 212 555 1003 {said(2)}"]  # known instances in unknown places
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "3530111333300000", "4242424242424242", "5555555555554444", "2223003122003222"]
    docs += [f"{said(2)} {c} {said(3)}" for c in cards]
    docs += [f"{said(2)} {cards[0]} 4012888888881881 {said(2)}", f"{said(2)} +1 (212) 555-9999 5105105105105100 {said(2)}"]  # side by side
    docs += [f"{said(2)} 1234567890123456 {said(2)}", f"{said(2)} {' '.join('1234 5678 9012'.split() * 4)} {said(2)}"]  # no card
    docs += [said(30) for _ in range(20)] + [None, "", "é" * 50 + " mailbox"]
    return docs


def test_discovery(spark):
    docs = planted(random.Random(5))
    rows = [(i % 60, t, 1, "x") for i, t in enumerate(docs)] + [(None, docs[0], 1, "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, k int, m string").repartition(4)
    out = pd_.find(df).collect()
    assert len(out) == len(rows)
    found = sorted((s["kind"], s["text"]) for r in out for s in r["spans"] if s["found"])
    want = [("email", f"hidden{i}@intranet") for i in range(4)] + [("phone", f"555-88-{3000 + i}") for i in range(4)]
    assert found == sorted([*want, ("email", "hidden1@intranet"), ("phone", "1 212 555 1003"), ("card", "4111111111111111"), ("card", "4012888888881881"),
                             ("card", "5105105105105100"), ("phone", "+1 (212) 555-9999")])
    digest = {(r["doc_id"], r["base_sha256"]) for r in pd_.digests(pd_.find(df)).collect()}
    assert digest == {(i, hashlib.sha256(base_text(t or "").encode()).hexdigest()) for i, t, _, _ in rows}
    assert pd_.digests(pd_.find(df.limit(0))).count() == 0


def test_query_against_plain_forms(spark):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = entry.queries()["op11_personal_data"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        want = naive(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in FORMS] == [len(h) for h in want.values()]
        assert r["base_sha256"] == hashlib.sha256(base_text(texts[r["doc_id"]]).encode()).hexdigest()
        assert set(base_text(texts[r["doc_id"]]).split(",")) <= set(r["spans"].split(","))
        spans = [(list(FORMS).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert spans == sorted(spans)


@pytest.mark.parametrize("kind,text,want", [(pd_.PHONE, "+1 (2)-3", "123"), (pd_.EMAIL, "A [at] B.c (dot) d", "a@b.c.d"), (pd_.IP, "FE80::1", "fe80::1")])
def test_values(kind, text, want):
    assert pd_.value(kind, text) == want
