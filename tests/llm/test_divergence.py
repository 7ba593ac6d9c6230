"""Divergence of sources against brute force and the oracle."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from speechprep.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, docs int"


def brute(rows, least=3, top=200):
    """The contract, term by term."""
    docs = [(r[2] or "", r[3] or "", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    docs = [(lang, source, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))) for lang, source, text in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = [t for t in held if held[t] >= least]
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            count[s].update({t: c[t] for t in kept if t in c})
        whole = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in count.items():
            pairs = [(sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), k) for k, o in count.items() if k != s]
            terms = [((share(c, t) - share(whole, t)) ** 2 // share(whole, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def odd():
    texts = ["The cat, the CAT!", "the cat's hat-hat 12", "The\thed ge Été été", None, "", " \n ", "12 34", "cat " * 3000 + "x" * 70_000, "the cat the cat", "the cat the cat", "Zug zug ZUG. zug", "hat, Hat; HAT hat"]
    rows = []
    for k, text in enumerate(texts * 3):
        rows.append((k if k % 7 else None, text, ["en", "en", "de", None, ""][k % 5], ["a", "b", None, "cé", ""][(k // 2) % 5], 1, "t", 2))
    return [*rows, (99, None, "fr", "a", 1, "t", 2), (100, "once only", "it", "a", 1, "t", 2), (101, "or twice", "it", "b", 1, "t", 2)]


def test_equals_brute_force(spark, odd):
    assert rows_of(divergence.audit(spark.createDataFrame(odd, SCHEMA).repartition(5))) == brute(odd)


def test_many_sources_in_small_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 2)
    got = rows_of(divergence.audit(spark.createDataFrame(odd, SCHEMA).repartition(6), top=2))
    assert got == brute(odd, top=2)


def test_short_stretches_of_sorted_rows(monkeypatch):
    """Sums and pairs don't hang on how many rows are worked at once."""
    rng = random.Random(3)
    chunk = [rng.choice(["the", "The,", "cat", "cat-dog", "12", "dog" * 9]) for _ in range(400)]
    rows = sorted(((0, c, rng.choice(["en", "de"]), [rng.randrange(3), 5], [1, 2], rng.choice([None, [rng.randrange(9)], [3, rng.randrange(4, 9)]])) for c in chunk), key=lambda r: r[1])
    schema = pa.schema([("home", pa.int32()), ("key", pa.string()), ("lang", pa.string()), ("numbers", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    def run(size, united):
        monkeypatch.setattr(divergence, "UNITED", united)
        out = pa.Table.from_batches(divergence._sorted_sums(3, True, False)(iter(table.to_batches(size))))
        out = out.sort_by("key")
        return pa.Table.from_batches(divergence._sorted_sums(3, False, True)(iter(out.to_batches(size)))).sort_by([(c, "ascending") for c in ("term", "lang", "number")]).to_pylist()

    whole = run(1000, 10**6)
    assert whole and all(run(size, united) == whole for size, united in ((7, 1), (50, 20), (3, 30)))
    kinds = [("lang", pa.string()), ("left", pa.int32()), ("right", pa.int32()), ("term", pa.string()), ("place", pa.int32()), ("p", pa.int64()), ("unseen", pa.list_(pa.int64()))]
    paired = [("en", 0, 0, None, 0, 0, [5, 6, 7])] + [("en", 0, 0, f"t{k:03}", i, rng.randrange(1, 99), None) for k in range(60) for i in range(3) if rng.random() < 0.6]
    table = pa.Table.from_pylist([dict(zip([k for k, _ in kinds], r, strict=True)) for r in paired], schema=pa.schema(kinds))

    def sums(size, cells):
        monkeypatch.setattr(divergence, "CELLS", cells)
        return pa.Table.from_batches(divergence._pairs(iter(table.to_batches(size)))).to_pylist()

    assert all(sums(size, cells) == sums(1000, 10**6) for size, cells in ((7, 1), (50, 20), (4, 40)))


def test_documents_of_a_term_are_distinct(spark):
    docs = spark.createDataFrame([("The the, THE the. a a", "en", "a"), ("the A,", "en", "a"), ("the-the a", "en", "b"), ("a", "de", "a"), ("a", "de", "a")], "text string, lang string, source string")
    sources = divergence.numbered_sources(docs)
    got = {(r.lang, r.number, r.term): (r.n, r.of_lang) for r in divergence.kept_terms(docs, sources).collect()}
    assert got == {("en", 0, "the"): (5, 7), ("en", 1, "the"): (2, 7), ("en", 0, "a"): (3, 4), ("en", 1, "a"): (1, 4)}
    assert {(r.lang, r.term) for r in divergence.kept_terms(docs, sources, 4).collect()} == set()


def test_large_counts_stay_exact(spark):
    n, total, terms = 10**13 + 7, 3 * 10**14 + 1, 12345
    got = spark.range(1).select(*[divergence.likely(F.lit(x), F.lit(total), F.lit(terms)).alias(str(k)) for k, x in enumerate((n, 0, divergence._FITS, divergence._FITS - 1))]).first()
    assert list(got) == [1 + 10**9 * (x + 1) // (total + terms) for x in (n, 0, divergence._FITS, divergence._FITS - 1)]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark, sf):
    for d in (sf, sf.replace("sf0.001", "sf0.01")):
        assert differences(queries.op11_source_divergence(spark, d), connect(d), queries.ORACLES["op11_source_divergence"]) == ""
