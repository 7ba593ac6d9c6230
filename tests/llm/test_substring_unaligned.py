"""Passages of 51 words set into the middle of sentences."""

import random

import numpy as np
import pyarrow as pa

from speechprep.llm import substring


def passage(rng, k, sentence):
    w = [f"p{k}x{rng.randrange(10**6)}" for _ in range(51)]
    if sentence:
        for i in range(rng.randrange(3, sentence), 51, sentence):
            w[i] += "."
    return " ".join(w)


def hosts(k, p):
    own = [f"h{k}y{j}" for j in range(30)]
    return f"Start. {' '.join(own[:7])} {p} {' '.join(own[7:12])}.", f"{' '.join(own[12:15])} {p} {' '.join(own[15:])}. End."


def test_every_unaligned_passage_has_a_run():
    rng, missed, n = random.Random(4), 0, 0
    for sentence in (0, 8, 13, 14, 16, 25):
        for k in range(200):
            s = substring.Sentences(pa.array(hosts(k, passage(rng, k, sentence))))
            i, h = s.runs()
            missed += not np.intersect1d(h[s.doc[i] == 0], h[s.doc[i] == 1]).size
            n += 1
    assert missed <= n // 400


def test_unaligned_passages_go(spark):
    rng = random.Random(9)
    pairs = [hosts(k, passage(rng, k, 14)) for k in range(20)]
    df = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    for k, (a, b) in enumerate(pairs):
        assert got[2 * k] == a
        left = got[2 * k + 1].split()
        assert sum(x.startswith("p") for x in left) <= 27 and "End." in left and f"h{k}y12" in left
