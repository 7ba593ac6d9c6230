"""Packing against the library and a plain cut."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from speechprep.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n ", "Hello, World!", "don't DON'T it's we'll 'tis '", "Été ÉTÉ ÀÇÿß ×÷ naïve", "é ́x àb", "İstanbul ΣΑΣ ς ǅ ﬁ", "a b c　d", "x" * 5000, "漢字かな 😀😀 ok", "12 3.4 5,6", "a.b.c ...!? .a a. ?!", "<|endoftext|> a<|startoftext|>b <|endof text|>", "\x00\x01\x1fa\x7fb\x85c​d", "tab\tnew\x0bline\x0cfeed\x1cfs", "word " * 9000, "Ã Â Ã̀"]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


@pytest.mark.parametrize("by_words", [True, False])
def test_ids_are_the_library_s(by_words):
    ids, at = packing.ids_of(PATH, pa.array(ODD * 2), by_words)
    got = [[*ids[a:b].tolist(), 2] for a, b in zip(at, at[1:], strict=False)]
    assert got == expected(ODD * 2)


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    for text in ["one two three", "four five six seven", "one eight nine ten eleven twelve one"]:
        ids, _ = packing.ids_of(PATH, pa.array([text]))
        assert [*ids.tolist(), 2] == expected([text])[0]


def checked(pieces, docs, window):
    """Pieces cover each document once and each sequence without gaps; only the last may be short."""
    want = expected([t for _, t in docs])
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    for a, b in zip(rows, rows[1:], strict=False):
        assert (b.sequence_id, b.offset) == ((a.sequence_id, a.offset + a.length) if a.offset + a.length < window else (a.sequence_id + 1, 0))
    assert not rows or (rows[0].sequence_id, rows[0].offset) == (0, 0)
    runs, now = [], []
    for r in rows:
        now.append(r)
        if r.start + r.length == r.doc_tokens:
            runs.append(now)
            now = []
    assert not now
    got = []
    for run in runs:
        assert run[0].start == 0 and all(b.start == a.start + a.length for a, b in zip(run, run[1:], strict=False))
        got.append((run[0].doc_id, tuple((r.length, r.ids_crc32) for r in run)))
    from collections import Counter

    def digest(ids, lengths):
        out, at = [], 0
        for n in lengths:
            out.append((n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert at == len(ids)
        return tuple(out)

    left = Counter(got)
    for (doc_id, _), ids in zip(docs, want, strict=True):
        fits = next(g for g in left if g[0] == doc_id and left[g] and sum(n for n, _ in g[1]) == len(ids) and g[1] == digest(ids, [n for n, _ in g[1]]))
        left[fits] -= 1
    assert not +left


def test_pieces_of_odd_rows(spark):
    docs = [(k if k % 5 else None, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3])]
    df = spark.createDataFrame([(*d, 1, "n") for d in docs], "doc_id long, text string, task int, ids string").repartition(5)
    for window in (4096, 64, 1):
        checked(packing.pack(df, PATH, 2, window, keep_ids=False).collect(), docs, window)
    assert packing.pack(df.limit(0), PATH, 2).count() == 0


def test_sequences_hold_the_ids_in_order(spark):
    docs = [(k, t) for k, t in enumerate(ODD)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), PATH, 2, 256)
    rows = pieces.collect()
    got = {r.sequence_id: r for r in packing.sequences(pieces, 256, 7).collect()}
    assert sorted(got) == list(range(len(got)))
    total = sum(len(x) for x in expected([t for _, t in docs]))
    assert sum(r.n_tokens for r in got.values()) == total and all(r.n_tokens == 256 for s, r in got.items() if s < len(got) - 1)
    whole = {s: np.frombuffer(r.ids, "<u4") for s, r in got.items()}
    assert all(x.size == 256 for x in whole.values())
    last = got[len(got) - 1]
    assert (whole[len(got) - 1][last.n_tokens :] == 7).all()
    assert total == sum(r.length for r in rows)


def test_query_over_the_small_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op12_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    checked(got.collect(), docs, 4096)
