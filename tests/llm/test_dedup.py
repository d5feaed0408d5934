"""De-duplication and similarity operators against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import exact_dedup, induced_sort, ngram_join, substring_dedup
from rollcall.llm.common import hold
from rollcall.llm.components import components

SCHEMA = "doc_id long, text string, key string, entry int, root string, found string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", "clash") for i, t in rows], SCHEMA)


def test_exact(spark):
    rows = [(1, "Abc"), (4, "aBC"), (2, None), (3, ""), (9, "é"), (8, "É"), (7, "abc "), (7, "abc "), (None, "only"), (None, "ABC"), (5, "long " * 5000)]
    groups = {}
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        own = groups[fold(t)]
        best = max((x for x in own if x is not None), default=None)
        want.append((i, best, len(own), hashlib.sha256(fold(t).encode()).hexdigest()))
    assert sorted(str((r[0], r[1], r[2], r[4])) for r in got) == sorted(map(str, want))
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs(spark, rows), keep="min")
    assert kept.count() == len(groups) and kept.columns == docs(spark, []).columns
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=rng.randint(0, 9))).encode() for _ in range(3000)]
    counts = {}
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, limit=5000)
    for w in words:
        trie.insert(w, 1)
        counts[w] = counts.get(w, 0) + 1
    assert trie.spilled and dict(trie.items()) == counts


def naive_components(rows, n, percent):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    sets = {i: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()) for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("short_list,block", [(48, 256), (2, 3)])
def test_ngram_join(spark, short_list, block):
    rng = random.Random(5)
    base = [rng.choice(["red", "blue", "Green", "the", "of", "é"]) + str(rng.randint(0, 30)) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two"), (5, "one two three four"), (6, "w " * 4000)]
    for i in range(10, 60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    rows += [(70 + i, " ".join(base[i:] + [f"t{k}" for k in range(i)])) for i in range(0, 20, 2)]
    got = ngram_join.ngram_components(docs(spark, rows), 4, 85, short_list=short_list, block=block).collect()
    assert sorted(tuple(r) for r in got) == naive_components(rows, 4, 85)


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (8, "other words are in this one"), (1, None), (2, "")]
    assert sorted(map(str, map(tuple, ngram_join.ngram_components(docs(spark, rows)).collect()))) == sorted(map(str, [
        (3, 3, 3), (3, 3, 3), (None, 3, 3), (8, 3, 8), (1, 0, 1), (2, 0, 2)]))
    left = ngram_join.drop_near_copies(docs(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 8]


@pytest.mark.parametrize("n", [4, 5])
def test_ngram_runs_of_few_words(spark, n):
    texts = [" ".join(f"w{k}" for k in range(size)).encode() for size in range(n + 2)]
    together = ngram_join.shingle_sets(texts, n)
    for text, want in zip(texts, together):
        assert ngram_join.shingle_sets([text], n)[0].tolist() == want.tolist()
    rows = [(size, " ".join(f"w{size}x{k}" for k in range(size))) for size in range(1, n + 1)]
    single = docs(spark, rows).repartitionByRange(n, "doc_id")
    assert sorted(tuple(r) for r in ngram_join.ngram_components(single, n, 85).collect()) == [(i, 1, i) for i in range(1, n + 1)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}


@pytest.mark.parametrize("memory", [1, 200, 1 << 27])
def test_suffix_array(memory):
    rng = np.random.default_rng(memory % 97)
    for _ in range(60):
        depth = int(rng.choice([3, 8, 50]))
        text = np.append(rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 120))), 0).astype(np.uint16)
        order, common = induced_sort.suffix_array(text, depth, memory)
        cut = [tuple(text[i:i + depth].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
        for a, b, n in zip(cut, cut[1:], common[1:].tolist()):
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert same == n


def naive_repeats(rows, length):
    late = lambda i: (i is None, i or 0)
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: late(r[0])):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p:p + length], late(i))
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < late(i):
                gone[p:p + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append(str((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("crowd", [16384, 2])
def test_repeats(spark, crowd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 400), (4, "b" + "a" * 200), (None, shared[0]), (5, shared[1]), (5, shared[1])]
    for i in range(10, 40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[:rng.randint(40, 120)])
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[-1][1]), (51, rows[-1][1].replace("a", "b", 1))]
    got = substring_dedup.repeats(docs(spark, rows), 50, crowd=crowd).collect()
    assert sorted(str(tuple(r)) for r in got) == naive_repeats(rows, 50)
    cut = substring_dedup.cut_repeats(docs(spark, rows), 50, crowd=crowd)
    assert cut.count() == len(rows) and cut.columns == docs(spark, []).columns
    assert cut.filter("doc_id = 50").first()["text"] == ""
    assert substring_dedup.repeats(docs(spark, []), 50).count() == 0


def test_repeats_of_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, 17_000_000, np.uint8).tobytes().decode()
    spans = [(0, 300), (999_900, 1_000_200), (16_777_100, 16_777_400), (16_999_000, 17_000_000)]
    after = [(2 + i, "<" + long[a:b] + ">") for i, (a, b) in enumerate(spans)]
    frame = docs(spark, [(1, long), *after]).coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup.repeats(frame, 50).collect()}
    assert got == {1: (len(long), 0, 0)} | {2 + i: (b - a + 2, b - a, 1) for i, (a, b) in enumerate(spans)}
    # a text just below 16 MB, followed by others in the same batch
    frame = docs(spark, [(1, long[:16_500_000]), (2, "x" * 30 + long[16_400_000:16_400_400]), (3, long[20:90]), (4, "y" * 30 + long[16_400_000:16_400_400])]).coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeats(frame, 50).collect()}
    assert got == {1: 0, 2: 400, 3: 70, 4: 400}


def crowded_rows(n):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(16))
    rows = [(n - i if i % 9 else None, " ".join([word(), word(), passage + word(), word()])) for i in range(n)]
    return passage, rows + [(5, rows[3][1]), (6, passage + rows[4][1])]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_of_a_crowd(spark, hot):
    _, rows = crowded_rows(240)
    got = substring_dedup.repeats(docs(spark, rows).repartition(3), 50, crowd=8, hot=hot).collect()
    assert sorted(str(tuple(r)) for r in got) == naive_repeats(rows, 50)


def test_windows_of_a_crowd_fold_before_they_move(spark):
    passage, rows = crowded_rows(1200)
    rows = sorted((i, t) for i, t in rows if i is not None)
    found = []
    for _, text in rows:
        record = np.zeros(1, substring_dedup.OPEN)
        record["first"], record["last"] = text.index(passage), text.index(passage) + len(passage) - 50
        found.append(record.tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()),
                                        pa.array([t for _, t in rows]), pa.array(found, pa.binary())], names=["doc", "hash", "text", "found"])
    moved = [r for out in substring_dedup._windows(50)(iter([batch])) for r in out.to_pylist()]
    # each window inside the passage moves once; the others become one decided run per document
    assert sum(r["piece"] is not None for r in moved) == len(passage) - 49
    assert sum(r["piece"] is None for r in moved) == len(rows) - 1


def test_owning_grams_are_dealt_evenly():
    """Owners are the least of many hashes: dealt by the hash itself, the first parts hold several times their share."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)) for _ in range(40)]
    gram = substring_dedup.owners(texts, 50)[4]
    load = np.bincount(substring_dedup._dealt(gram, 100), minlength=100)
    assert len(load) == 100 and load.max() < 1.5 * load.mean()


def test_decided_runs_are_merged_and_copies_spread():
    """Windows that overlap or touch travel as one run, and copies of one text lie in a few buckets."""
    who = np.array([[doc, 77] for doc in range(1000) for _ in range(3)])
    low = np.tile([0, 14, 90], 1000)
    rows = substring_dedup._decided(who, low, np.tile([64, 80, 150], 1000), 50)
    records = np.concatenate([np.frombuffer(r[3], substring_dedup.PAIR) for r in rows])
    assert sorted(records.tolist()) == sorted((doc, 77, a, b) for doc in range(1000) for a, b in ((0, 80), (90, 150)))
    sizes = [len(r[3]) for r in rows]
    assert 8 <= len(sizes) <= 16 and max(sizes) < sum(sizes) / 3


def batches_of(texts, size):
    for a in range(0, len(texts), size):
        part = texts[a:a + size]
        yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array(part)],
                                         names=["doc", "hash", "text"])


def test_lines_of_owning_grams_hold_many():
    """A task writes a line per fragment, not one per run of documents and fragment: with many fragments those hold a few grams each."""
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, 4_000, np.uint8).tobytes().decode() for _ in range(1000)]
    texts += [t[:2000] + "." + t[2000:] for t in texts[:50]]
    lines = [r for b in substring_dedup._own(3000, 3000, 50)(batches_of(texts, 100)) for r in b.to_pylist()]
    assert len([r for r in lines if r["kind"] == 0]) <= 3000 and len([r for r in lines if r["kind"] == 1]) <= 50
    assert len({r["frag"] for r in lines if r["kind"] == 0}) > 2900
    # folding gathers the records of several fragments as well
    lines.sort(key=lambda r: r["frag"])
    batch = pa.RecordBatch.from_pylist([{k: r[k] for k in ("frag", "kind", "who", "body")} for r in lines if r["kind"] == 0], schema=pa.schema(
        [("frag", pa.int32()), ("kind", pa.int32()), ("who", pa.binary()), ("body", pa.binary())]))
    folded = [r for b in substring_dedup._fold(20, 50, 16384)(iter([batch])) for r in b.to_pylist()]
    assert len(folded) <= 3 * 20


def test_owning_grams_travel_unchanged():
    rng = np.random.default_rng(7)
    who = np.stack([rng.integers(-1 << 62, 1 << 62, 90), rng.integers(-1 << 62, 1 << 62, 90)], 1)
    who[5, 0] = substring_dedup.LAST_ID
    cols = {name: rng.integers(0, 90 if name == "doc" else np.iinfo(kind).max, 400, kind) for name, kind in substring_dedup.OWN}
    lines = [substring_dedup._packed(who, {name: c[a:b] for name, c in cols.items()}) for a, b in ((0, 150), (150, 151), (151, 400))]
    back, got = substring_dedup._unpacked(lines)
    assert (back[got["doc"]] == who[cols["doc"]]).all()
    assert all((got[name] == cols[name]).all() for name, _ in substring_dedup.OWN if name != "doc")


def test_contexts_without_a_common_side_are_not_sorted(spark):
    """A gram of 24 bytes between different bytes holds no common window; 13 bytes more on one side may."""
    rng = np.random.default_rng(9)
    noise = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    shared = {n: noise(n) for n in (24, 49, 50, 60)}
    texts = [noise(80) + s + noise(80) for s in shared.values() for _ in range(2)]
    lines = [r for b in substring_dedup._own(1, 1, 50)(batches_of(texts, 100)) for r in b.to_pylist()]
    batch = pa.RecordBatch.from_pylist([{k: r[k] for k in ("frag", "kind", "who", "body")} for r in lines], schema=pa.schema(
        [("frag", pa.int32()), ("kind", pa.int32()), ("who", pa.binary()), ("body", pa.binary())]))
    asked = np.concatenate([np.frombuffer(r["body"], substring_dedup.OPEN) for b in substring_dedup._fold(1, 50, 16384)(iter([batch]))
                            for r in b.to_pylist() if r["kind"] == 2])
    assert set(asked["doc"]) <= {2, 3, 4, 5, 6, 7} and {4, 5, 6, 7} <= set(asked["doc"])
    got = [r["n_removed"] for r in substring_dedup.repeats(docs(spark, list(enumerate(texts))), 50).orderBy("doc_id").collect()]
    assert got == [0, 0, 0, 0, 0, 50, 0, 60]


def test_held_tables_leave_no_shuffle_files(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, None)

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    there = shuffled()
    rows = hold(spark.range(1000).repartition(5, "id"), tidy=True)
    for _ in range(50):
        if not shuffled() - there:
            break
        time.sleep(0.1)
    assert not shuffled() - there and rows.count() == 1000 and spark.conf.get(conf, None) == before
