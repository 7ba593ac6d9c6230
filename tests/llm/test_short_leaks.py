"""Documents that are a benchmark item less some words."""

import pytest

from speechprep.llm import decontam
from test_dedup import bag, likeness, words


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            for k in range(max(len(w) - len(v), 0) + 1):
                s = likeness(bag(" ".join(w[k : k + len(v)])), bag(it))
                if s >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_items_cut_short(spark):
    items = [(k, " ".join(f"w{k}x{j % 50}" for j in range(n))) for k, n in enumerate((4, 5, 6, 12, 60, 61, 200))]
    docs = [(1000 * k + less, " ".join(t.split()[less // 2 : len(t.split()) - (less + 1) // 2])) for k, t in items for less in range(0, min(len(t.split()) - 1, 60))]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert (4005, 4) in want
    assert {k: r.similarity for k, r in got.items()} == pytest.approx(want)
    assert got[4005, 4].first_word == 0 and got[4005, 4].windows == 1
    left = {r.doc_id for r in decontam.drop_leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
