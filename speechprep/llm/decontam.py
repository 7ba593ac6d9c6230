"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact check.

Items and documents are cut into lower-cased words and runs of five (an item with fewer words is
one run).  Every window of a document as long as an item is a candidate place, and so is the whole
of a shorter document.  Its fingerprint is the sign of ``BITS`` = 256 sums of +-1 over its runs.
The fingerprints of equal-sized items lie in 16 sorted tables, one for each block of 16 bits; a
window looks up its block and all values within two bits of it, so by the pigeonhole principle
every item within ``RADIUS`` = 47 < 16 * 3 bits is found.  Items beyond that which share such a
block are checked as well.  At a similarity of 0.8 two fingerprints differ in about 39 bits, and the
chance that no block is within two bits is below 1e-5; a random item is reached with 0.033.  A match
is a pair whose multiset of runs has a weighted Jaccard similarity of ``THRESHOLD`` or more.

Before fingerprints, an exact bound drops windows: of m runs in window and item alike, a
similarity s needs at least 2ms/(1+s) runs to be runs of some item of that size; of k < m runs in a
document cut short, (m+k)s/(1+s).

The benchmark is broadcast in blocks of at most ``ITEM_WORDS`` words, one pass over the documents
for each block, so no broadcast grows with the benchmark; workers make the tables from it.

Edge cases: null and empty texts and items match nothing; an item without words is skipped, one
with a null item_id is an item like others; repeated documents give repeated rows, equal items one row
each; a null doc_id is kept as null; other columns pass through ``drop_leaked``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.arrays import U, chunks, mix, occurrence, prose_words, run_hash, tables

WORDS, THRESHOLD, BITS, BLOCK_BITS, NEAR = 5, 0.8, 256, 16, 2
RADIUS = BITS // BLOCK_BITS * (NEAR + 1) - 1
#: Words of the benchmark in one broadcast, and windows fingerprinted at once.
ITEM_WORDS, WINDOWS = 2_000_000, 2048
_ORDER = np.arange(64, dtype=U)
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_SMALL = np.array([v for v in range(1 << BLOCK_BITS) if bin(v).count("1") <= NEAR], dtype=np.int64)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Signs of ``n x BITS`` sums as ``n x BITS / 64`` words."""
    return ((sums > 0).reshape(len(sums), -1, 64).astype(U) << _ORDER).sum(axis=2, dtype=U)


def lanes(keys: np.ndarray) -> np.ndarray:
    """``n x BITS`` of +-1, from as many hashes of each key as it takes."""
    words = np.stack([mix(keys, 50 + k) for k in range(BITS // 64)], axis=1)
    return (((words[:, :, None] >> _ORDER) & U(1)).astype(np.int32).reshape(keys.size, BITS) << 1) - 1


def window_prints(runs: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of the windows of ``k`` runs that begin at ``first``, a bounded stretch of the document at a time."""
    low = 0
    while low < first.size:
        high = int(np.searchsorted(first, first[low] + WINDOWS))
        a, b = int(first[low]), int(first[high - 1]) + k
        total = np.zeros((b - a + 1, BITS), dtype=np.int32)
        np.cumsum(lanes(runs[a:b]), axis=0, out=total[1:])
        here = first[low:high]
        yield here, fingerprint(total[here - a + k] - total[here - a])
        low = high


def within(known: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which runs are in the sorted, non-empty array ``known``."""
    return known[np.minimum(np.searchsorted(known, runs), known.size - 1)] == runs


class Tables:
    """Fingerprints of the items of one size, sorted by each of their blocks."""

    def __init__(self, members: list[int], runs: list[np.ndarray]):
        self.members = np.array(members)
        self.prints = np.concatenate([fingerprint(lanes(runs[k]).sum(axis=0)[None, :]) for k in members])
        self.own = np.unique(np.concatenate([runs[k] for k in members]))
        blocks = self.prints.view(np.uint16).astype(np.int64)
        self.order = np.argsort(blocks, axis=0, kind="stable")
        self.sorted = np.take_along_axis(blocks, self.order, axis=0)

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (window, item) that have a block within ``NEAR`` bits."""
        blocks, found = marks.view(np.uint16).astype(np.int64), []
        for b in range(BITS // BLOCK_BITS):
            probe = (blocks[:, b, None] ^ _SMALL).reshape(-1)
            low, high = (np.searchsorted(self.sorted[:, b], probe, side=s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            found.append(np.repeat(hit // _SMALL.size, many) * self.members.size + self.order[at, b])
        pairs = np.unique(np.concatenate(found))
        return pairs // self.members.size, pairs % self.members.size


class Index:
    """Items of a block, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        words, at = prose_words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.runs: list[np.ndarray] = []
        by_size: dict[int, list[int]] = {}
        for k in range(len(items)):
            w = words[at[k] : at[k + 1]]
            n = min(WORDS, w.size)
            start = np.arange(w.size - n + 1 if n else 0)
            self.runs.append(run_hash(w, start, start + n) if n else np.zeros(0, U))
            if n:
                by_size.setdefault(w.size, []).append(k)
        self.known = np.unique(np.concatenate(self.runs)) if self.runs else np.zeros(0, U)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.known >> U(44)).astype(np.int64)] = True
        self.sizes = {size: Tables(members, self.runs) for size, members in sorted(by_size.items())}

    def knows(self, runs: np.ndarray) -> np.ndarray:
        return within(self.known, runs)

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item -> (best similarity, first word of that window, number of windows that match)."""
        found: dict[int, tuple[float, int, int]] = {}
        for n in sorted({min(WORDS, s) for s in self.sizes}):
            if words.size < n:
                continue
            start = np.arange(words.size - n + 1)
            runs = run_hash(words, start, start + n)
            at = np.flatnonzero(self.bitmap[(runs >> U(44)).astype(np.int64)])
            at = at[self.knows(runs[at])]
            if not at.size:
                continue
            for size, own in self.sizes.items():
                m = size - n + 1
                if min(WORDS, size) != n or runs.size < m * THRESHOLD - 1e-9:
                    continue
                k = min(m, runs.size)
                hits = np.zeros(runs.size + 1, dtype=np.int64)
                hits[1 + at[within(own.own, runs[at])]] = 1
                hits = np.cumsum(hits)
                first = np.flatnonzero(hits[k:] - hits[:-k] >= (m + k) * THRESHOLD / (1 + THRESHOLD) - 1e-9)
                for here, marks in window_prints(runs, first, k):
                    for w, i in zip(*own.near(marks), strict=True):
                        item, place = int(own.members[i]), int(here[w])
                        s = similarity(runs[place : place + k], self.runs[item])
                        if s >= THRESHOLD - 1e-12:
                            best, at_word, many = found.get(item, (-1.0, 0, 0))
                            found[item] = (s, place, many + 1) if s > best else (best, at_word, many + 1)
        return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    a, b = (np.unique(np.stack([x, occurrence(x, np.zeros(x.size, np.int64)).astype(U)]), axis=1).T for x in (a, b))
    both = len(set(map(tuple, a.tolist())) & set(map(tuple, b.tolist())))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in order, in blocks of bounded size, through a local iterator: the driver holds one block."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.split())
        if block and size + n > ITEM_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    yield block


def made(key: str, items: list[tuple[int | None, str]]) -> Index:
    """Made once in each worker, which keeps the tables of its last block."""
    mine = tables("decontam")
    if key not in mine:
        mine.clear()
        mine[key] = Index(items)
    return mine[key]


def _shared(docs: DataFrame, block: list[tuple[int | None, str]]):
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))
    return lambda: made(*sent.value)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, similarity, first_word, windows)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(benchmark):
        index = _shared(docs, block)
        one = docs.mapInArrow(_search(index), "doc_id long, item_id long, similarity double, first_word long, windows long")
        out = one if out is None else out.unionByName(one)
    return out


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index()
        for batch in batches:
            for part in chunks(batch, "text"):
                words, at = prose_words(part.column("text"))
                rows = [(part.column("doc_id")[d].as_py(), ix.ids[k], s, w, n) for d in _touched(ix, words, at) for k, (s, w, n) in sorted(ix.search(words[at[d] : at[d + 1]]).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "windows"])

    return run


def _touched(ix: Index, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Documents of a chunk that hold a run of some item; the others have similarity 0 to all of them."""
    hit = np.zeros(words.size, dtype=bool)
    for n in {min(WORDS, s) for s in ix.sizes}:
        if words.size >= n:
            start = np.arange(words.size - n + 1)
            runs = run_hash(words, start, start + n)
            maybe = np.flatnonzero(ix.bitmap[(runs >> U(44)).astype(np.int64)])
            hit[maybe[ix.knows(runs[maybe])]] = True
    return np.unique(np.searchsorted(at, np.flatnonzero(hit), side="right") - 1)


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no benchmark item; rows are judged one by one."""
    names = [f.name for f in docs.schema]
    out = docs
    for block in _blocks(benchmark):
        index = _shared(docs, block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index()
            for batch in batches:
                for part in chunks(batch, "text"):
                    words, at = prose_words(part.column("text"))
                    keep = np.ones(part.num_rows, dtype=bool)
                    for d in _touched(ix, words, at):
                        keep[d] = not ix.search(words[at[d] : at[d + 1]])
                    yield pa.RecordBatch.from_arrays(part.columns, names=names).filter(pa.array(keep))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out
