"""Substring dedup of texts with characters whose lower case has another byte length."""

import numpy as np
import pyarrow as pa

from speechprep.llm import substring

PASSAGE = "Été à Köln BEGINNT früh. Ärger ÜBER Öl und Äpfel bleibt heute aus. Москва СПИТ ещё долго und fest. ΑΘΗΝΑ wacht schon seit Stunden auf. Énorme ÉTÉ très chaud à Paris et ailleurs."
ODD = "\u212a \u2126 \u0130 \u1e9e \u023a"


def test_hashes_hang_on_the_text_alone():
    def hashes(s, i, j):
        return s.digests(np.arange(i, j), np.arange(i, j) + 1)

    alone = hashes(s := substring.Sentences(pa.array([PASSAGE])), 0, s.doc.size)
    for other in (ODD, "\u0130", "\u023a", "\u212a\u023a\u023a"):  # the last keeps the length of the whole text
        s = substring.Sentences(pa.array([other, PASSAGE, f"{other} ends. {PASSAGE}"]))
        assert (hashes(s, s.at[1], s.at[2]) == alone).all()
        assert (hashes(s, s.at[3] - alone.size, s.at[3]) == alone).all()


def test_raw_bytes_are_cut_at_the_same_characters(spark):
    rows = [(1, PASSAGE), (2, f"{ODD} stays.\n{PASSAGE.upper()} Own {ODD} end."), (3, f"\u212a\u023a\u023a own. {PASSAGE}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    assert got == {1: PASSAGE, 2: f"{ODD} stays.\nOwn {ODD} end.", 3: "\u212a\u023a\u023a own."}


def test_words_in_thue_morse_order_are_told_apart(spark):
    """Sums modulo 2^64 over such sequences and their complements are equal; no hash of theirs may be."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    a, b = (" ".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    c, d = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    tail = " ".join(f"z{k}." for k in range(40))
    s = substring.Sentences(pa.array([f"{a}. {tail}", f"{b}. {tail}", f"{c}. {c} end {tail}", f"{d}. {d} end {tail}"]))
    i, h = s.runs()
    hashes = [{x.tobytes() for x, at in zip(h, i, strict=True) if at == s.at[d]} for d in range(4)]
    assert all(hashes) and not hashes[0] & hashes[1] and not hashes[2] & hashes[3]
    rows = [(k, " ".join(f"p{j}{word}" for j in range(60)) + ".") for k, word in enumerate((c, d))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(*row, 0) for row in rows]


def test_rows_of_one_id_are_told_apart():
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    texts = ["".join("ab"[x ^ y] for x in bits) for y in (0, 1)]
    ids, rows = substring.row_keys(pa.RecordBatch.from_pydict({"doc_id": [7, 7], "text": texts}))
    assert rows[0] != rows[1]
