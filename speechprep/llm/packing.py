"""Packing by concatenating and cutting: token ids of all documents in one row, cut into fixed windows.

Pass one tokenises: each task writes its documents' ids, and before each the running total of the
task, to the shared folder.  The tasks' totals are summed up, in two levels, to the offset of each
task's first id.  Pass two cuts documents at the windows' borders, where no row needs another one.
So every sequence is full but the last, ids are in one piece each, and neither pass shuffles texts.
``sequences`` puts the pieces together again: windows inside a task's stretch where they are, and those that
reach over its ends as boundary records.

Ids are those of the library, but texts are tokenised by distinct words: no rule of these tokenizers
crosses white space.  A word of Latin letters, with stops after it or without, is lower-cased
here and its letters' ids are remembered, up to ``WORDS`` words a worker; every other word goes through the library each
time.  A tokenizer for which white space means something is to be used with ``by_words=False``, which gives it whole texts.

Edge cases: a null text counts as empty and has the end id only; a text of any length is tokenised
whole; repeated rows and null ids are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.arrays import SPACED, chunks, flat, runs, spans, strings, tables
from speechprep.llm.shards import small
from speechprep.llm.store import cut

WINDOW, SLICE_BYTES, WORDS, SUMMED = 4096, 6 << 20, 800_000, 1024
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_TWO = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])  # after 0xC3: U+00C0 to U+00FF without the signs of multiplication and division
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def _tokenizer(path: str):
    mine = tables("packing")
    if path not in mine:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        mine[path] = Tokenizer.from_file(path)
    return mine[path]


def _library(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side, and each one's number of them."""
    ids, n = [], []
    for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False):
        own = e.ids
        ids += own
        n.append(len(own))
    return np.array(ids, dtype=np.uint32), np.array(n, dtype=np.int64)


class Known:
    """Ids of the words met so far, side by side; it starts anew past ``WORDS``."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.at, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 0

    def of(self, path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Store, starts and ends of each word's ids."""
        if len(self.place) + len(words) > WORDS:
            self.__init__()
        new = [w for w in words if w not in self.place]
        for a in range(0, len(new), 20_000):
            got, n = _library(path, [w.decode() for w in new[a : a + 20_000]])
            first = len(self.place)
            total = self.size + int(n.sum())
            if total > self.ids.size:
                self.ids = np.concatenate([self.ids, np.zeros(max(total - self.ids.size, self.ids.size), np.uint32)])
            if first + n.size + 1 > self.at.size:
                self.at = np.concatenate([self.at, np.zeros(max(n.size + 1, self.at.size), np.int64)])
            self.ids[self.size : total] = got
            self.at[first + 1 : first + n.size + 1] = self.size + np.cumsum(n)
            self.place.update(zip(new[a : a + 20_000], range(first, first + n.size), strict=True))
            self.size = total
        k = np.fromiter((self.place[w] for w in words), np.int64, len(words))
        return self.ids, self.at[k], self.at[k + 1]


def _by_words(path: str, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all distinct words side by side, and each one's n+1 offsets."""
    buf, at = flat(words)
    if not len(words):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    stop, letter = _STOPS[buf], _LETTER[buf]
    lead = buf == 0xC3
    second = np.zeros(buf.size, bool)
    second[1:] = lead[:-1] & _TWO[buf[1:]]
    pair = second.copy()
    pair[:-1] |= second[1:]
    core = letter | pair
    n_core, n_stop = (np.add.reduceat(x.astype(np.int64), at[:-1]) for x in (core, stop))
    size = np.diff(at)
    ends = at[:-1] + n_core  # a plain word is its letters and then its stops
    inside = np.concatenate([[0], np.cumsum(core)])
    plain = (n_core + n_stop == size) & (n_core > 0) & (inside[np.minimum(ends, at[1:])] - inside[at[:-1]] == n_core)
    folded = np.where(letter, _FOLD[buf], np.where(second & (buf <= 0x9E), buf + np.uint8(32), buf))
    k = np.flatnonzero(plain)
    cores = strings(folded, at[k], ends[k]).dictionary_encode()
    tails = strings(buf, ends[k], at[k + 1]).dictionary_encode()
    others = np.flatnonzero(~plain)
    mine = tables("packing")
    store, a, b = mine.setdefault(f"{path} words", Known()).of(path, cores.dictionary.cast(pa.large_binary()).to_pylist())
    rest, n = _library(path, [*tails.dictionary.to_pylist(), *words.take(pa.array(others)).to_pylist()])
    more = np.concatenate([[0], np.cumsum(n)]) + store.size
    store = np.concatenate([store, rest])
    c, t = cores.indices.to_numpy(), tails.indices.to_numpy()
    first, last = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)  # two ranges of the store a word
    first[k, 0], last[k, 0], first[k, 1], last[k, 1] = a[c], b[c], more[t], more[t + 1]
    own = len(tails.dictionary) + np.arange(others.size)
    first[others, 0], last[others, 0] = more[own], more[own + 1]
    n = (last - first).sum(axis=1)
    return store[runs(first.ravel(), last.ravel())], np.concatenate([[0], np.cumsum(n)])


def ids_of(path: str, texts: pa.Array, by_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts side by side, and the n+1 offsets of each text's."""
    if not by_words:
        ids, n = _library(path, [x or "" for x in texts.to_pylist()])
        return ids, np.concatenate([[0], np.cumsum(n)])
    buf, offsets = flat(texts)
    start, end, doc = spans(SPACED[buf], offsets)
    words = strings(buf, start, end).dictionary_encode()
    ids, own = _by_words(path, words.dictionary)
    code = words.indices.to_numpy()
    n = np.concatenate([[0], np.cumsum(own[code + 1] - own[code])])
    return ids[runs(own[code], own[code + 1])], n[np.searchsorted(doc, np.arange(len(texts) + 1))]


def tokenised(docs: DataFrame, path: str, end_id: int, by_words: bool = True) -> DataFrame:
    """(doc_id, task, before, n, ids) of ``docs``: ids with ``end_id`` as little-endian unsigned 32-bit integers, and the ids before them in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                ids, at = ids_of(path, part.column("text"), by_words)
                raw, n = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.diff(at) + 1
                cells = [bytes(raw[4 * a : 4 * b]) + end for a, b in zip(at, at[1:], strict=False)]
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(n.size, task, np.int32)), pa.array(before), pa.array(n), pa.array(cells, pa.binary())], names=["doc_id", "task", "before", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, task int, before long, n long, ids binary")


def _offsets(tokens: DataFrame) -> DataFrame:
    """(of, first): the place of each task's first id; totals are summed up within blocks of tasks and then over these."""
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("task") / SUMMED))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("all")).select(F.col("block").alias("b"), (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("earlier"))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("task")) - F.col("n")
    return totals.withColumn("within", within).join(small(blocks), F.col("block") == F.col("b")).select(F.col("task").alias("of"), (F.col("within") + F.col("earlier")).alias("first"))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, keep_ids: bool = True, by_words: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece of a document in a sequence, with its ids (as in ``tokenised``) if ``keep_ids``."""
    tokens = cut(tokenised(docs, path, end_id, by_words), "tokens")
    placed = tokens.join(small(cut(_offsets(tokens), "offsets")), F.col("task") == F.col("of")).select("doc_id", (F.col("first") + F.col("before")).alias("at"), "n", "ids")
    schema = _PIECE + ", ids binary" if keep_ids else _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
            first = at // window
            many = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(n.size), many)
            sequence = first[row] + np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)
            start = np.maximum(sequence * window - at[row], 0)
            end = np.minimum((sequence + 1) * window - at[row], n[row])
            raw = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            cells = [raw[r][4 * a : 4 * b] for r, a, b in zip(row, start, end, strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - start), pa.array([zlib.crc32(x) for x in cells], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(at[row] + start - sequence * window)]
            if keep_ids:
                columns.append(pa.array([bytes(x) for x in cells], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return placed.mapInArrow(run, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that follow one another in a window become one record."""
    now, offset, cells = None, 0, []

    def out() -> pa.RecordBatch:
        ids = b"".join(cells)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([offset], pa.int64()), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], names=["sequence_id", "offset", "n_tokens", "ids"])

    size = 0
    for batch in batches:
        for k, at, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "offset", "ids")), strict=True):
            if (k, at) != (now, offset + size):
                if now is not None:
                    yield out()
                now, offset, cells, size = k, at, [], 0
            cells.append(ids)
            size += len(ids) // 4
    if now is not None:
        yield out()


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Pieces with ids -> (sequence_id, n_tokens, ids): each window's ids, the last one padded to ``window``.

    Windows that one task's pieces fill are put together where they are; the others, two at the ends of
    what a task reads, are boundary records and meet by their number.
    """
    records = cut(pieces.select("sequence_id", "offset", "ids").mapInArrow(_joined, "sequence_id long, offset long, n_tokens long, ids binary"), "windows")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))")
    met = records.filter(F.col("n_tokens") < window).groupBy("sequence_id").agg(F.sum("n_tokens").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))
    pad = np.array([pad_id], "<u4").tobytes().hex()
    filled = F.concat("ids", F.expr(f"unhex(repeat('{pad}', cast({window} - n_tokens as int)))"))
    return records.filter(F.col("n_tokens") == window).drop("offset").unionByName(met).withColumn("ids", filled)
