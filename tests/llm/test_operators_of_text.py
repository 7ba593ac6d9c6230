"""BPE, language ID, fingerprints, URL rules, LM scoring, sharding and license scans."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, differences
from pyspark.sql import functions as F

from speechprep.llm import bpe, fingerprint, kneser_ney, langid, licenses, queries, shards, urls

SCHEMA = "doc_id long, text string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(sorted(RANKS)).map(lambda b: b.decode("utf-8", "ignore")), max_size=8).map("".join))
def test_bpe_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    encoder, decoder = bpe.ready(PATH, PATTERN)
    data = encoder.encode(text)
    ids = list(struct.unpack(f"<{len(data) // 4}I", data))
    assert ids == LIBRARY.encode_ordinary(text)
    assert decoder.feed(ids) + decoder.finish() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=12))
def test_stream_decoder_replaces_what_is_no_utf8(ids):
    _, decoder = bpe.ready(PATH, PATTERN)
    got = "".join(decoder.feed([t]) for t in ids) + decoder.finish()
    raw = b"".join(decoder.bytes_of[t] for t in ids)
    want = raw.decode("utf-8", "replace")
    assert got.replace("�", "") == want.replace("�", "")
    if "�" not in want:
        assert got == want


def test_bpe_tables_are_bounded_within_a_piece(monkeypatch):
    monkeypatch.setattr(bpe, "FST_BYTES", 60_000)
    monkeypatch.setattr(bpe, "PIECE_BYTES", 3_000)
    monkeypatch.setattr(bpe, "PAIRS", 200)
    encoder, rng = bpe.Encoder(RANKS, PATTERN), __import__("random").Random(7)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), " ".join("".join(rng.choice("aeinrst") for _ in range(7)) for _ in range(500))]
    for text in texts + texts:
        data = encoder.encode(text)
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == LIBRARY.encode_ordinary(text)
        assert encoder.fst.size <= 65_000 and encoder.size <= 3_000 and len(encoder.fst.pairs) <= 200
        assert all(len(p) <= bpe.SHORT for p in encoder)


def test_bpe_rows(spark):
    rows = [(1, "Hello  world's été 😀"), (2, None), (3, ""), (4, "x" * 50_000), (4, "x" * 50_000), (None, "a\n\n b")]
    got = bpe.encode(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int"), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        assert list(by[i].ids) == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, PATTERN).count() == 0


def test_language_held_out_accuracy(spark, sf):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def brute_language(train, ask):
    """Naive Bayes over hashed n-grams in plain Python: language -> score of each text."""
    m32 = 0xFFFFFFFF

    def buckets(t):
        plain = ""
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or not plain or plain[-1] != " ":
                plain += c
        for n in (1, 2, 3):
            for i in range(len(plain) - n + 1):
                h = 0
                for c in plain[i : i + n]:
                    h = (h * 0x01000193 & m32) ^ (ord(c) * 0x9E3779B1 & m32)
                h = ((h ^ h >> 15) * 0x85EBCA6B + n) & m32
                yield ((h ^ h >> 13) * 0xC2B2AE35 & m32) >> 18

    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train:
        if t is not None and lang is not None and any(c.isalpha() for c in t):
            counts[lang].update(buckets(t))
            docs[lang] += 1
    out = []
    for t in ask:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        score = {k: math.log(docs[k] / docs.total()) + sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * langid.BUCKETS)) for b in buckets(t)) for k, c in counts.items()}
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(x - score[best]) for x in score.values())))
    return out


def test_language_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "WORKED", 3000)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1500").collect()]
    rows += [(-1, "Ünïcode ÉTÉ İ ẞ", "fr"), (-2, None, "en"), (-3, "1 2", "xx"), (-4, "so", None), (-5, "a" * 40_000, "en"), (-6, "ab", "zz"), (-7, "ab", "yy"), (-7, "ab", "yy"), (-8, "ab", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    train = [(t, k) for i, t, k in rows if i % 3]
    langs, matrix = langid.train(df.filter("doc_id % 3 <> 0"))
    assert langs == sorted({k for t, k in train if t and k and any(c.isalpha() for c in t)})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langs, matrix, df.doc_id).collect()}
    for (i, t, _), want in zip(rows, brute_language(train, [t for _, t, _ in rows]), strict=True):
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-9), (i, t)
    assert got[-7] == got[-6] == got[-8]  # equal texts, whatever their label


def test_language_ties_empty_tables_and_clashing_names(spark):
    rows = spark.createDataFrame([("ab", "zz"), ("ab", "yy")], "text string, lang string")
    langs, matrix = langid.train(rows)
    ask = spark.createDataFrame([(1, "ab", 5, 6)], "doc_id long, text string, `#text` int, `#pred` int")
    r = langid.predict(ask, langs, matrix, *[F.col(f"`{c}`") for c in ask.columns], named=("lang", "s")).first()
    assert (r.lang, r.s, r["#text"], r["#pred"]) == ("yy", 0.5, 5, 6)  # a tie goes to the first language
    assert langid.predict(ask.limit(0), langs, matrix, ask.doc_id).count() == 0


def test_language_edge_cases(spark):
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    langs, matrix = langid.train(rows)
    assert langs == ["de", "en"]
    ask = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "THE DOG", "de"), (5, "die katze", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(ask, langs, matrix, *[ask[c] for c in ask.columns]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de" and 0.5 < got[5][1] <= 1
    langs, matrix = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.predict(ask, langs, matrix, ask.doc_id).collect()} == {"und"}


def test_fingerprint_rows(spark):
    rows = [(3, "a. b. c.\nd."), (9, "x y z. Été 😀!\nsecond"), (1, None), (7, "d.\na. b. c."), (5, "q" * 1000), (5, "q" * 1000)]
    got = fingerprint.edited(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id int")).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    following = {order[k]: order[(k + 1) % len(order)][1] for k in range(len(order))}
    following[5, "q" * 1000] = {"q" * 1000, "a. b. c.\nd."}
    prints = {}
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        n = len(text)
        assert r.n_chars == n
        nexts = following[r.doc_id, text]
        want = {hashlib.sha256((text[: n - n // 3] + x[: n // 3]).encode()).hexdigest() for x in ([nexts] if isinstance(nexts, str) else nexts)}
        assert r.edited_sha256 in want
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[r.doc_id] = r.fingerprint
    assert prints[3] == prints[7] and len(set(prints.values())) == 4
    assert fingerprint.edited(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint.edited(spark.createDataFrame([(1, "abc")], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one.near_next == 1.0


def test_fingerprint_neighbours_over_many_ranges(spark):
    ids = [7 * k % 1009 for k in range(1009)]
    df = spark.createDataFrame([(i, f"t{i}", -i) for i in ids], "doc_id long, text string, id long").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df).collect()}
    assert got == {i: f"t{(i - 1) % 1009}" for i in ids}
    assert fingerprint.with_next(df).columns == ["doc_id", "text", "id", "next_text"]


def brute_fingerprint(text):
    """Lanes of eq and sim with XXH64 from its own library."""
    import xxhash

    def h(k, b):
        return xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(struct.pack("<i", k), seed=42))

    eq = [0] * 8
    for p in text.split("\n"):
        for k in range(4):
            x = h(k, p)
            eq[2 * k] = (eq[2 * k] + (x & 0xFFFFFFFF)) % 2**32
            eq[2 * k + 1] = (eq[2 * k + 1] + (x >> 32)) % 2**32
    units = []
    for sentence in re.split(r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])", text):
        if len(sentence) <= fingerprint.UNIT_WORDS * 6:
            units += [sentence] if sentence else []
        else:
            units += [m[0] for m in re.finditer(rf"(?:\S{{1,{fingerprint.WORD_CHARS}}}\s*+){{1,{fingerprint.UNIT_WORDS}}}+", sentence)]
    sums = [0] * 120
    for u in units:
        for k in range(2):
            x = h(100 + k, u)
            for i in range(20):
                for j in range(3):
                    sums[60 * k + 3 * i + j] += 1 if x >> (i + 20 * j) & 1 else -1
    return eq, sums


def test_likeness_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-5, None), (-6, "a. b! c?\nd e f g"), (-6, "w " * 30_000)]
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    if got[-6, 60_000].edited_sha256 != hashlib.sha256(("w " * 20_000 + (order[-1][1] if order[-1][1].startswith("a") else order[0][1])[:20_000]).encode()).hexdigest():
        order[-1], order[-2] = order[-2], order[-1]

    def like(a, b):
        if a[0] == b[0]:
            return 1.0
        dot = sum(x * y for x, y in zip(a[1], b[1], strict=True))
        size = math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
        return min(max(dot / size, 0.0), 1.0) if size else 0.0

    for k, (i, t) in enumerate(order):
        nxt, n = order[(k + 1) % len(order)][1], len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        r, own = got[i, n], brute_fingerprint(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint[:64] == "".join(f"{x:08x}" for x in own[0])
        assert (r.near_edited, r.near_next) == pytest.approx((like(own, brute_fingerprint(edited)), like(own, brute_fingerprint(nxt)))), i


def test_crowded_ids_are_cut_by_text(spark):
    rows = [(None, f"n{k}") for k in range(300)] + [(5, f"f{k}") for k in range(200)] + [(k, f"t{k}") for k in range(10, 60)] + [(3, "same")] * 40 + [(-(2**62) - 1, "low"), (2**62 + 1, "high"), (2**62, "high too")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `#id` int").repartition(5)
    got = fingerprint.with_next(df).collect()
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], -tie[r[1]]), reverse=True)
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want
    assert got[0].asDict().keys() == {"doc_id", "text", "#id", "next_text"}


def test_fingerprint_insert_and_delete(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("one. two.\nthree.", "four! five.", "four! five.\nthree.\none. two.")], "a string, b string, c string")
    for c in "abc":
        eq, sim = fingerprint.fingerprint(c)
        df = df.withColumn(f"f{c}", F.struct(eq.alias("eq"), sim.alias("sim")))
    for name, (eq, sim) in {"s": fingerprint.plus("fa", "fb"), "d": fingerprint.plus("fc", "fb", -1)}.items():
        df = df.withColumn(name, F.struct(eq.alias("eq"), sim.alias("sim")))
    r = df.first()
    assert r.s == r.fc and r.d == r.fa


def test_urls_equal_oracle(spark, sf):
    for d in (sf, "/root/testdata/sf0.01"):
        assert differences(queries.op7_url_trie(spark, d), connect(d), queries.ORACLES["op7_url_trie"]) == ""


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        ("http://WWW.Example.com/en/x?q#f", ("www.example.com", "/en/x", "www.example.com/en/", "allow")),
        ("http://a.example.com/en/", ("a.example.com", "/en/", "example.com/en/", "block")),
        ("http://a.example.com/en", ("a.example.com", "/en", "com/", "allow")),
        ("http://notexample.com/en/x", ("notexample.com", "/en/x", "com/", "allow")),
        ("x://b.net/fr/1#/es/", ("b.net", "/fr/1", "net/fr/", "block")),
        ("http://b.net?/es/", ("b.net", "", None, "allow")),
        ("http://é.com:80/", ("é.com:80", "/", None, "allow")),
    ],
)
def test_url_cases(url, want):
    host, path = urls.parts(url)
    assert (host, path, *urls.Trie(urls.RULES).match(host, path)) == want


def brute_kneser_ney(docs, train, order):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + ["</s>"]

    def level(counts):
        """Total and followers by count of each context, and the discounts."""
        total, followers = Counter(), defaultdict(Counter)
        for (*a, _), c in counts.items():
            total[tuple(a)] += c
            followers[tuple(a)][min(c, 3)] += 1
        return counts, total, followers, kneser_ney.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])

    uni, bi, tri = Counter(), Counter(), Counter()
    for t in train:
        w = words(t)
        uni.update(w)
        bi.update(zip(["<s>", *w], w, strict=False))
        tri.update(zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    cont = Counter(b for _, b in bi)
    levels = [level(bi)] if order == 2 else [level(Counter((b, c) for _, b, c in tri)), level(tri)]
    low = kneser_ney.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    types = sum(cont.values())
    spare = sum(low[min(c, 3) - 1] for c in cont.values())

    def p(history, w):
        c = cont[w]
        out = (c - (low[min(c, 3) - 1] if c else 0) + spare / (v + 1)) / types if types else 1 / (v + 1)
        for k, (counts, total, followers, d) in enumerate(levels, 1):
            a = tuple(history[-k:])
            if total[a]:
                c = counts[(*a, w)]
                out = (c - (d[min(c, 3) - 1] if c else 0) + sum(d[j - 1] * m for j, m in followers[a].items()) * out) / total[a]
        return out

    vocabulary = [*uni, "<unknown>"]
    for a in [("<s>", "<s>"), *list(zip(list(uni)[:9], list(uni)[1:], strict=False)), *[x[:2] for x in list(tri)[:9]], ("<unknown>", "<unknown>")]:
        assert sum(p(a, w) for w in vocabulary) == pytest.approx(1)
    out = {}
    for i, t in docs:
        w = words(t)
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p((a, b), x)) for a, b, x in zip(["<s>", "<s>", *w], ["<s>", *w], w, strict=False)))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_brute_force(spark, sf, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").collect()] + [(1000, None), (1001, ""), (1002, "A a A  a\n" * 300), (1003, "to be " * 20_000)]
    docs = spark.createDataFrame([(i, zlib.crc32(str(i).encode()) % 7 == 2, t, 1.0) for i, t in rows], "doc_id long, held_out boolean, text string, score double")
    model = kneser_ney.fit(docs.filter("not held_out"), order)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in kneser_ney.score(docs.unionByName(docs), model).collect()}
    want = brute_kneser_ney(rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], order)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i]), i
    model.drop()


def test_kneser_ney_without_training(spark):
    docs = spark.createDataFrame([(1, True, "a b")], "doc_id long, held_out boolean, text string")
    r = kneser_ney.score(docs, kneser_ney.fit(docs.limit(0), 2)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert kneser_ney.score(docs.limit(0), kneser_ney.fit(docs)).count() == 0


def test_shards_law(spark):
    rows = [(k, "é" * (k % 50)) for k in range(1000)] + [(None, None), (3, None), (3, None), (4, "a very long text " * 60_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string").repartition(7)
    got = shards.assign(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shards.assign(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert ids != sorted(ids)
    assert shards.assign(df.limit(0)).count() == 0


def test_shards_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}", k * 2) for k in range(100)], "doc_id long, text string, extra long")
    shards.write(df, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.extra) for r in back.collect()) == [(k, f"text {k}", k * 2) for k in range(100)]
    assert {r.n for r in back.groupBy("shard").count().selectExpr("count as n").collect()} == {20}


def test_assign_describes_written_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(shards, "new_folder", lambda spark, name: str(tmp_path / name))
    rows = [(k, f"té {k} " * (k % 9), "s", k, 5) for k in range(500)] + [(None, None, "s", 1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long, `#index` int").repartition(3)
    got = shards.assign(df, shards=5).collect()
    back = spark.read.parquet(str(tmp_path / "shards")).withColumn("file", F.input_file_name()).collect()
    assert sorted(((r.doc_id, r.text, r.shard, r.slot, r["#index"]) for r in back), key=str) == sorted(rows, key=str)
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r["shard-"], r["slot-"]) for r in back}
    for k in range(5):
        own = sorted((r.file, r["slot-"]) for r in back if r["shard-"] == k)
        assert [s for _, s in own] == list(range(len(own))) and len({f for f, _ in own}) > 2


def test_order_hangs_on_rows_and_seed_alone(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_BYTES", 2000)
    rows = [(k, "x" * (k % 40)) for k in range(400)] + [(7, "the same again")] * 300 + [(None, "null and again")] * 200
    df, seen = spark.createDataFrame(rows, SCHEMA), {}
    for n in (4, 9):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = shards.assign(df.repartition(n)).collect()
        seen[n] = sorted(((r.shard, r.slot, r.doc_id, r.text_crc32) for r in got), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[4] == seen[9] and len(seen[4]) == len(rows)
    placed = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert max(len(list(g)) for k, g in __import__("itertools").groupby(placed) if k == 7) < 30  # copies are strewn
    other = shards.assign(df, seed=5).collect()
    assert sorted(((r.shard, r.slot, r.doc_id, r.text_crc32) for r in other), key=str) != seen[4]


LICENSED = [
    (1, "Code.\nReleased under the MIT License."),
    (2, "Licensed under the Apache License, Version 2.0. apache LICENSE"),
    (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "Licensed under CC BY-NC 4.0."),
    (5, "nothing here"),
    (6, None),
    (7, "word " * 3000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files (the Software), to deal in the Software without any restriction " + "word " * 500),
    (8, ""),
    (8, ""),
    (None, "mit\nlicense; été MIT license"),
    (11, "front " * 77 + licenses.MIT + " back" * 50),
    (12, licenses.BSD.replace("Redistributions", "Copies").lower()),
    (13, "license " * 40 + "under some words the " + "other " * 30 + "mit " + "more " * 30 + "released"),
]


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
    labels, score = set(base), 0.0
    for label, t, naming in licenses.TEMPLATES:
        t = re.findall(r"[0-9a-z]+", t.lower())
        size, need = 2, set(t)
        while size < 2 * len(t):
            size *= 2
        for k in range(0, max(len(w), 1), size // 2):
            have = set(w[k : k + size])
            both = len(have & need) / len(need)
            if both >= licenses.CONTAINED - 1e-12 and have >= set(naming.split()):
                labels.add(label)
                score = max(score, both)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9))


def test_licenses_equal_brute_force(spark, sf):
    rows = LICENSED + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")).collect()
    mine = sorted((str(r.doc_id), str((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)))) for r in got)
    assert mine == sorted((str(i), str(brute_licenses(t))) for i, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[11] == "mit" and labels[12] == "bsd,bsd-3-clause" and labels[13] == ""
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_near_a_short_notice_are_not_named_by_it(spark):
    want = {
        "Released under the Apache License": "apache",
        "released under the terms of a license granted by court": "",
        "licensed under CC BY 4.0": "",
        "Licensed under the MIT License, Version 2.0": "mit,mit-notice",
        "This work is licensed under the terms of the Public License, version 3": "",
        "Released under the MIT License": "mit,mit-notice",
        "licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        "Source Code Form is subject to the terms of the Mozilla Public License, version 2.0": "mpl-2.0",
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[i] for i, t in rows} == want
    with pytest.raises(ValueError):
        licenses.joins([("x", "some license", "other")], {})
    tied = [("a", "one two three four five", ""), ("b", "six one two three four", ""), ("c", "one two three four seven", "seven")]  # equal frequencies: the order goes by token
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "one two three four"), (3, "five six seven")], SCHEMA)
    assert {r.doc_id: r.labels for r in licenses.scan(docs, {}, tied).collect()} == {1: "a,b,c", 2: "a,b", 3: ""}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
        docs = docs.cache()
        sizes.append(docs.count())
    assert 0 < sizes[3] < sizes[0] <= 200 and sizes[1] == sizes[2]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sizes[-1]
