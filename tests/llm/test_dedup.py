"""Near-dedup, substring dedup and decontamination against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from speechprep.llm import decontam, near_dup, substring
from speechprep.llm.arrays import U, mix, prose_words

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\xbf -ⁿ　-〿]+")


def words(t):
    return WORD.findall((t or "").lower())


def bag(t, k=5):
    w = words(t)
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1 if w else 0)))


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Components of all pairs at 0.8 or more, by least id."""
    bags = [(i, bag(t)) for i, t in rows if words(t)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = defaultdict(set)
    for k, (_, b) in enumerate(bags):
        for g in b:
            seen[g].add(k)
    pairs = {(x, y) for s in seen.values() for x in s for y in s if x < y}
    for x, y in pairs:
        if likeness(bags[x][1], bags[y][1]) >= 0.8:
            a, b = find(bags[x][0]), find(bags[y][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def brute_links(rows):
    """For each id the number of other word sequences at 0.8 or more."""
    texts = {}
    for i, t in rows:
        texts.setdefault(tuple(words(t)), []).append(i)
    bags = {w: bag(" ".join(w)) for w in texts if w}
    seen = defaultdict(set)
    for w, b in bags.items():
        for g in b:
            seen[g].add(w)
    out = {i: 0 for i, _ in rows}
    for w, b in bags.items():
        n = sum(likeness(b, bags[v]) >= 0.8 for v in set().union(*(seen[g] for g in b)) - {w})
        out.update(dict.fromkeys(texts[w], n))
    return out


def test_signature_is_unbiased():
    rng = random.Random(3)
    a = Counter(rng.randrange(40) for _ in range(300))
    b = Counter({k: max(1, v + rng.randrange(-4, 5)) for k, v in a.items()}) + Counter(range(100, 112))
    true = sum((a & b).values()) / sum((a | b).values())
    got = []
    for s in range(40):
        keys = mix(np.array([k + 1000 * s for c in (a, b) for k in c], dtype=U), 9)
        x = near_dup.bag_signatures(keys, np.array([v for c in (a, b) for v in c.values()]), np.array([d for d, c in enumerate((a, b)) for _ in c]), 2)
        got.append((x[0] == x[1]).mean())
    assert abs(np.mean(got) - true) < 0.025


def test_classes_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(5)
    base = words(rows[7][1])[:150]
    for k in range(60):  # a star of near copies, most of them not near each other
        w = list(base)
        for i in rng.sample(range(len(w)), rng.randrange(1, 12)):
            w[i] = f"edit{k}x{i}"
        rows.append((10_000 + k, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in found} == brute_classes(rows)
    assert {r.doc_id: r.n_links for r in found} == brute_links(rows)


def test_near_dup_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " .,! "), (9, "one two"), (2, "One, two!"), (2, "One, two!"), (8, long), (7, long + " end"), (None, "three four five six seven eight"), (6, "a b c d e f")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, rows_alike int")
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5), (4, 4), (3, 3), (9, 2), (2, 2), (2, 2), (8, 7), (7, 7), (None, None), (6, 6)], key=str)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([5, 4, 3, 2, 7, None, 6], key=str)
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_meet_their_near_copies(spark):
    w = [f"w{i}" for i in range(100)]
    near = " ".join(["other", *w[1:]])
    for a, b in ((3, 7), (None, 7), (3, None), (None, None)):
        df = spark.createDataFrame([(a, " ".join(w), 1), (b, near, 2), (9, "far from both of them", 3)], "doc_id long, text string, `#node` int")
        got = near_dup.classes(df).collect()
        assert len({r.root for r in got}) == 2 and len(got) == 3
        want = min((x for x in (a, b) if x is not None), default=None)
        assert sorted((r.class_id for r in got), key=str) == sorted([want, want, 9], key=str)
        kept = near_dup.keep_one(df.withColumn("#key", df.doc_id).withColumn("#Rows", df.doc_id))
        assert kept.columns == ["doc_id", "text", "#node", "#key", "#Rows"] and kept.count() == 2
        assert {r.doc_id for r in kept.collect()} == {want, 9}


def crowd(n, pairs, rng):
    """``n`` texts of a common part and words of their own, about half alike, and ``pairs`` near copies of some of them."""
    common = [f"c{i}" for i in range(130)]
    rows = [(k, " ".join(common + [f"o{k}x{i}" for i in range(62)])) for k in range(n)]
    for k in range(pairs):
        v = rows[k][1].split()
        for i in rng.sample(range(135, 190), 4):
            v[i] = f"e{k}x{i}"
        rows.append((10 * n + k, " ".join(v)))
    return rows


def test_crowded_buckets_keep_their_pairs(spark, monkeypatch):
    """Texts half alike fill the buckets, which are compared whole, in pairs of blocks."""
    monkeypatch.setattr(near_dup, "BUCKET", 24)
    monkeypatch.setattr(near_dup, "BLOCK_KEYS", 3000)
    rows = crowd(900, 150, random.Random(8))
    want = brute_classes(rows)
    assert sum(want[10 * 900 + k] == want[k] for k in range(150)) > 140
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == want


def test_links_between_blocks_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"s{k}", *base])) for k in range(40)] + [(100 + k, " ".join(["s1", *base])) for k in range(30)] + [(300, None), (301, "alone in the world")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (0, 39) for i, _ in rows[:70]} | {300: (300, 0), 301: (301, 0)}


def test_structured_texts_are_nodes_of_their_own(spark):
    one = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    rows = [(1, " ".join(one)), (2, " ".join("ba"["ab".index(x)] for x in one))]
    assert len({r.node for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}) == 2


def sentence_parts(t):
    """The words of each sentence; a long one is cut after words whose hash divides by CUT."""
    out = []
    for s in re.split(r"\n|(?<=[.!?])(?=[\t\n\x0b\x0c\r ])", t or ""):
        w, now = words(s), []
        for i, x in enumerate(w):
            now.append(x)
            if i == len(w) - 1 or len(w) > substring.PIECE and int(prose_words(pa.array([x]))[0][0]) % substring.CUT == 0:
                out.append(tuple(now))
                now = []
    return out


def test_substring_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    first, removed = {}, defaultdict(set)
    for i, t in sorted(rows):
        parts = sentence_parts(t)
        for k in range(len(parts)):
            j = k + substring.RUN
            while j <= len(parts) and sum(map(len, parts[k:j])) < substring.LEAST:
                j += 1
            if j <= len(parts) and first.setdefault(tuple(parts[k:j]), (i, k)) != (i, k):
                removed[i] |= set(range(k, j))
    got = {r.doc_id: r for r in substring.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {i: len(x) for i, x in removed.items()}
    for i, t in rows:
        parts = sentence_parts(t)
        assert got[i].n_sentences == len(parts)
        if i in removed:
            assert [w for k, p in enumerate(parts) if k not in removed[i] for w in p] == words(got[i].text)
        else:
            assert got[i].text == t


def test_substring_edge_cases(spark):
    passage = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu. Xi omicron pi rho sigma tau. Upsilon phi chi psi omega."
    rows = [(1, f"Start here now. {passage}", "x"), (2, f"{passage} An own end.", "y"), (3, None, "z"), (4, "", "z"), (None, "Some text.", "n"), (5, passage, "a"), (5, passage, "a"), (6, "Own words only, all of them new.", "b")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row string, `#row` int, `#gone` int, n_removed int")
    out = substring.remove_repeats(df, ("a", "b"))
    assert out.columns == [*df.columns, "a", "b"]
    assert {(r["#row"], r["#gone"], r.n_removed) for r in out.collect()} == {(1, 2, 3)}
    long = " ".join(f"v{i}" for i in range(40_000))
    both = substring.remove_repeats(spark.createDataFrame([(1, f"{passage} {long}"), (2, long + ". Own end here.")], SCHEMA)).collect()
    assert {r.doc_id: len(r.text) < 1000 for r in both} == {1: False, 2: True}
    got = sorted(((r.doc_id, r.text, r.row) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], "x"), (2, "An own end.", "y"), (3, None, "z"), (4, "", "z"), (None, "Some text.", "n"), (5, "", "a"), (5, "", "a"), (6, rows[7][1], "b")], key=str)
    assert substring.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            for k in range(len(w) - len(v) + 1 if v else 0):
                s = likeness(bag(" ".join(w[k : k + len(v)])), bag(it))
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_leaks_equal_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1500").collect()]
    rng = random.Random(1)
    for k, (_, t) in enumerate(items):  # one word changed, and too many changed
        w = t.split()
        near, far = list(w), list(w)
        near[len(w) // 2] = "changed"
        for i in rng.sample(range(len(w)), len(w) // 3):
            far[i] = "other"
        docs += [(5000 + k, "pre " * 9 + " ".join(near) + " post"), (6000 + k, " ".join(far))]
    items += [(900, "two words"), (901, "?!"), (902, None), (None, "of no number at all but long enough"), (903, items[0][1])]
    docs += [(7000, "say two words now"), (7001, None), (7002, ""), (7003, "it is of no number at all but long enough, really"), (7004, "x " * 30_000 + items[3][1] + " y" * 30_000), (7005, items[5][1]), (7005, items[5][1])]
    rows = decontam.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in rows}
    want = brute_leaks([d for d in docs if d[0] != 7004], items) | {(7004, items[3][0]): 1.0}
    assert got.keys() == want.keys() and (7003, None) in got and sum(r.doc_id == 7005 for r in rows) == 2 * sum(d == 7005 for d, _ in want)
    assert got == pytest.approx(want)


def test_index_reaches_few_items_and_all_near_ones():
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 1 << 63, 100, dtype=np.int64).astype(U) for _ in range(3000)]
    tables = decontam.Tables(list(range(3000)), runs)
    near = []
    for k in range(300):  # of 100 runs 11 others: a similarity of 0.80
        near.append(np.append(runs[k][11:], rng.integers(0, 1 << 63, 11, dtype=np.int64).astype(U)))
    marks = np.concatenate([decontam.fingerprint(decontam.lanes(x).sum(axis=0)[None, :]) for x in near])
    w, i = tables.near(marks)
    assert {(k, k) for k in range(300)} <= set(zip(w.tolist(), i.tolist(), strict=True))
    assert w.size < 0.05 * 300 * 3000
    flipped = tables.prints[:1].copy()
    for b in rng.permutation(256)[: decontam.RADIUS]:
        flipped[0, b // 64] ^= U(1) << U(b % 64)
    assert 0 in tables.near(flipped)[1]


def test_drop_leaked(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y", 1), (2, "clean text", 2), (None, None, 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(None, "One two, three four five six seven.")], "item_id long, text string")
    assert sorted((r.item_id for r in decontam.drop_leaked(docs, items).collect())) == [2, 3]
    assert decontam.drop_leaked(docs, items.limit(0)).count() == 3
    assert decontam.leaks(docs.limit(0), items).count() == 0
