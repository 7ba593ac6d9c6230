"""Fingerprints of texts without full stops."""

import random

from speechprep.llm import fingerprint


def test_edited_is_nearer_than_next(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"{rng.randrange(10**6):x}" for _ in range(300))) for k in range(12)]
    rows += [(100 + k, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500))) for k in range(6)]
    rows += [(200 + k, "".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(12)) + "。" for _ in range(60))) for k in range(6)]
    for r in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_edited > 0.35 and r.near_edited > r.near_next + 0.2, r.doc_id
