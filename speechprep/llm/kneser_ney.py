"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and read from memory maps.

1. Word counts: tasks send one sorted block of (hash, count) per bucket; buckets add them up.
2. With order 3, trigram counts in shards by the hash of the context (u, v).  Each shard writes its
   sorted hash array and counts to the shared folder, and sends on the contexts' statistics (how
   often, followers by count 1, 2, 3+) and each distinct trigram's last two words.
3. Bigrams in shards by the hash of the first word: with order 2 counted in the text, with order 3
   by the number of words before them.  Each shard writes its arrays and sends on, per word, how
   often it is a context, its followers by count 1, 2, 3+, and its number of predecessors.
4. Buckets add these to the word counts and write the sorted word arrays.
5. Workers memory-map the arrays and score whole texts by sorted binary search.

A word with more than 1/8 of a shard's share of tokens is *hot* (so there are at most 8 x shards of
them): its bigrams are spread by both words, and the trigrams behind two hot words by all three.  The
number of shards follows the bytes of the training texts.

p(w|uv) = (c(uvw) - D)/c(uv) + g(uv) p(w|v), p(w|v) and p(w) likewise from continuation counts (with
order 2, p(w|v) from counts), the last over the uniform distribution on the vocabulary and one
unknown word.  The model's files grow with the corpus and stay on the shared folder, which must be a
mounted file system (``file:``), as memory maps need one; a worker's resident part is what it
touches; ``Model.drop`` deletes them.  Files are written under another name and then renamed, so a task
that runs twice leaves the same file.

Edge cases: a null or empty text has one token, its end; without training rows N = V = 0 and every
probability is 1; repeated rows count as often as they stand; equal texts have equal scores; columns but
doc_id, held_out and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechprep.llm.arrays import SPACED, U, ascii_lower, chunks, flat, mix, span_hash, spans
from speechprep.llm.store import cut, new_folder

END, BEGIN = U(0x6A09E667F3BCC908), U(0xBB67AE8584CAA73B)
#: Distinct entries that a task holds before it sends them on, and bytes of text scored at once.
HELD, SCORED = 2_000_000, 4 << 20
#: Bytes of training text for a shard.
SHARD_BYTES = 16 << 20
#: c: how often in the text; t: how often as a context; cc: words before it.
_WORD = np.dtype([("word", "<u8"), ("c", "<u8"), ("t", "<u8"), ("cc", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_CONTEXT = np.dtype([("word", "<u8"), ("t", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_BLOCK = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde")])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one END after each text, and each text's n+1 offsets."""
    buf, offsets = flat(texts)
    buf = ascii_lower(buf)
    start, end, doc = spans(SPACED[buf], offsets)
    n = len(texts)
    at = np.searchsorted(doc, np.arange(n + 1)) + np.arange(n + 1)
    out = np.full(start.size + n, END, dtype=U)
    out[np.arange(start.size) + doc] = span_hash(buf, start, end)
    return out, at


def before(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = np.empty_like(words)
    v[1:] = words[:-1]
    v[at[:-1]] = BEGIN
    return v


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9E3779B97F4A7C15) + mix(w, 21))


def crowded(u: np.ndarray, v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return np.isin(u, hot) & np.isin(v, hot)


def triple_shard(context: np.ndarray, key: np.ndarray, spread: np.ndarray, shards: int) -> np.ndarray:
    return (np.where(spread, key, mix(context, 31)) % U(shards)).astype(np.int64)


def shard_of(v: np.ndarray, key: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    own = np.where(np.isin(v, hot), key, mix(v, 31)) if hot.size else mix(v, 31)
    return (own % U(shards)).astype(np.int64)


def bucket_of(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word, 41) % U(buckets)).astype(np.int64)


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if k.size else np.zeros(0, np.int64)
    return (k[first], *(np.add.reduceat(v[order], first) if k.size else v for v in values))


def _blocks(to: np.ndarray, n: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that has entries."""
    order = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(edge))
    cells = [[x[order][edge[b] : edge[b + 1]].tobytes() for b in some] for x in columns]
    cells += [[None] * some.size] * (5 - len(cells))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(some.size, kind, np.int32)), *(pa.array(x, pa.binary()) for x in cells)], schema=_SCHEMA)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in chunks(batch, "text"):
            yield tokens(part.column("text"))


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            w, c = added(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            return _blocks(bucket_of(w, buckets), buckets, 0, w, c.astype("<u8"))

        for words, at in _training(batches):
            held.append(np.unique(np.append(words, np.full(at.size - 1, BEGIN)), return_counts=True))
            size += held[-1][0].size
            if size >= HELD:
                yield send()
                size = 0
        if held:
            yield send()

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket together; they come sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now and rows:
                yield now, rows
                rows = []
            now = r["bucket"]
            rows.append(r)
    if rows:
        yield now, rows


def _joined(rows: list[dict], kind: int, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows if r["kind"] == kind), dtype=dtype)


def _add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _each(batches):
        w, c = added(_joined(rows, 0, "a", "<u8"), _joined(rows, 0, "b", "<u8"))
        yield _blocks(np.full(w.size, bucket), bucket + 1, 0, w, c)


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                w, c = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                if (on := c >= least).any():
                    yield pa.RecordBatch.from_arrays([pa.array(w[on].astype(np.int64))], names=["word"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, distinct = 0, 0
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            on = np.frombuffer(a, "<u8") != BEGIN
            total += int(np.frombuffer(b, "<u8")[on].sum())
            distinct += int(on.sum())
    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([distinct])], names=["n", "v"])


def _count_pairs(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            v, w, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            key = pair(v, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            v, w, c = v[order][first], w[order][first], np.add.reduceat(c[order], first)
            to = shard_of(v, key[first], hot, shards)
            order = np.lexsort((v, to))
            v, w, c, to = v[order], w[order], c[order], to[order]
            return _shard_rows(v, w, c, to, shards)

        for words, at in _training(batches):
            v = before(words, at)
            _, first, c = np.unique(pair(v, words), return_index=True, return_counts=True)
            held.append((v[first], words[first], c))
            size += first.size
            if size >= HELD:
                yield send()
                size = 0
        if held:
            yield send()

    return run


def _shard_rows(v: np.ndarray, w: np.ndarray, c: np.ndarray, to: np.ndarray, shards: int) -> pa.RecordBatch:
    """First words once each with the number of their pairs, then second words and counts."""
    edge = np.searchsorted(to, np.arange(shards + 1))
    some, cells = np.flatnonzero(np.diff(edge)), [[], [], [], []]
    for s in some:
        part = slice(edge[s], edge[s + 1])
        own = v[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for to_list, x in zip(cells, (own[first], np.diff(np.append(first, own.size)).astype("<u4"), w[part], c[part].astype("<u4")), strict=True):
            to_list.append(x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.zeros(some.size, np.int32)), *(pa.array(x, pa.binary()) for x in cells), pa.array([None] * some.size, pa.binary())], schema=_SCHEMA)


def _count_triples(shards: int, hot: np.ndarray):
    """Kind 5: contexts, second words, third words, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            spread, context, v, w, c = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            key = pair(context, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            spread, context, v, w = (x[order][first] for x in (spread, context, v, w))
            return _blocks(triple_shard(context, key[first], spread, shards), shards, 5, context, v, w, np.add.reduceat(c[order], first).astype("<u4"))

        for words, at in _training(batches):
            v = before(words, at)
            u = before(v, at)
            context = pair(u, v)
            _, first, c = np.unique(pair(context, words), return_index=True, return_counts=True)
            held.append((crowded(u[first], v[first], hot), context[first], v[first], words[first], c))
            size += first.size
            if size >= HELD:
                yield send()
                size = 0
        if held:
            yield send()

    return run


def _write_counts(path: str, key: np.ndarray, c: np.ndarray) -> None:
    """Sorted keys with counts in a byte, and those of 255 or more apart."""
    over = np.flatnonzero(c >= 255)
    _write(path, np.array([key.size, over.size], "<u8"), key, key[over], c[over].astype("<u8"), np.minimum(c, 255).astype("u1"))


def _of_counts(c: np.ndarray) -> np.ndarray:
    """The numbers of entries with count 1 to 4, as one cell."""
    return np.array([(c == k).sum() for k in (1, 2, 3, 4)], "<i8")[None, :].view("V32").reshape(-1)


def _add_triples(folder: str, shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _each(batches):
            context, v, w = (_joined(rows, 5, x, "<u8") for x in "abc")
            c = _joined(rows, 5, "d", "<u4").astype(np.int64)
            del rows
            key = pair(context, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, context, v, w, c = key[first], context[order][first], v[order][first], w[order][first], np.add.reduceat(c[order], first)
            _write_counts(f"{folder}/triples-{shard}", key, c)
            x = added(context, c, *((on).astype("<u4") for on in (c == 1, c == 2, c >= 3)))
            yield _blocks(bucket_of(x[0], shards), shards, 4, x[0], x[1].astype("<u8"), *(y.astype("<u4") for y in x[2:]))
            yield _blocks(np.zeros(1, np.int64), 1, 6, _of_counts(c))
            both = pair(v, w)
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
            v, w, c = v[order][first], w[order][first], np.diff(np.append(first, both.size))
            to = shard_of(v, both[order][first], hot, shards)
            order = np.lexsort((v, to))
            yield _shard_rows(v[order], w[order], c[order], to[order], shards)

    return run


def _write(path: str, *arrays: np.ndarray) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x).data)
    os.replace(own, path)


def _add_pairs(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _each(batches):
            if any(r["kind"] == 4 for r in rows):
                x = added(_joined(rows, 4, "a", "<u8"), _joined(rows, 4, "b", "<u8"), *(_joined(rows, 4, n, "<u4") for n in "cde"))
                out = np.zeros(x[0].size, dtype=_CONTEXT)
                for name, y in zip(_CONTEXT.names, x, strict=True):
                    out[name] = y
                _write(f"{folder}/contexts-{shard}", out)
            for r in rows:
                if r["kind"] == 6:
                    yield pa.RecordBatch.from_pylist([r | {"bucket": 0}], schema=_SCHEMA)
            v = np.repeat(_joined(rows, 0, "a", "<u8"), _joined(rows, 0, "b", "<u4"))
            w, c = _joined(rows, 0, "c", "<u8"), _joined(rows, 0, "d", "<u4").astype(np.int64)
            del rows
            if not v.size:
                continue
            key = pair(v, w)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, v, w, c = key[first], v[order][first], w[order][first], np.add.reduceat(c[order], first)
            _write_counts(f"{folder}/pairs-{shard}", key, c)
            x = added(v, c, *(on.astype("<u4") for on in (c == 1, c == 2, c >= 3)))
            yield _blocks(bucket_of(x[0], buckets), buckets, 1, x[0], x[1].astype("<u8"), *(y.astype("<u4") for y in x[2:]))
            y, cc = added(w, np.ones(w.size, np.int64))
            yield _blocks(bucket_of(y, buckets), buckets, 2, y, cc.astype("<u4"))
            yield _blocks(np.zeros(1, np.int64), 1, 3, _of_counts(c))

    return run


_STATS = [f"{x}{i}" for x in "tpl" for i in range(1, 5)] + ["types", "l3up"]


def _finish_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _each(batches):
            word, c = added(_joined(rows, 0, "a", "<u8"), _joined(rows, 0, "b", "<u8"))
            out = np.zeros(word.size, dtype=_WORD)
            out["word"], out["c"] = word, c
            v, *n = added(_joined(rows, 1, "a", "<u8"), _joined(rows, 1, "b", "<u8"), *(_joined(rows, 1, x, "<u4") for x in "cde"))
            at = np.searchsorted(word, v)
            for name, x in zip(("t", "n1", "n2", "n3"), n, strict=True):
                out[name][at] = x
            w, cc = added(_joined(rows, 2, "a", "<u8"), _joined(rows, 2, "b", "<u4").astype(np.int64))
            out["cc"][np.searchsorted(word, w)] = cc
            _write(f"{folder}/words-{bucket}", out)
            triples, pairs = (np.frombuffer(b"".join(r["a"] for r in rows if r["kind"] == k), "<i8").reshape(-1, 4).sum(axis=0) for k in (6, 3))
            cc = out["cc"]
            low = [int((cc == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*triples, *pairs, *low, cc.sum(dtype=np.int64), (cc >= 3).sum())], names=_STATS)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries with count 1 to 4, kept within 0 to the count."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


class Model:
    """Opened once in each worker: sorted arrays as memory maps, and the few numbers that hold for all."""

    def __init__(self, folder: str, shards: int, hot: np.ndarray, n: int, v: int, order: int, stats: dict[str, int]):
        self.folder, self.shards, self.hot, self.n, self.v, self.order, self.types = folder, shards, hot, n, v, order, stats["types"]
        self.top, self.high, self.low = (discounts([stats[f"{x}{i}"] for i in range(1, 5)]) for x in "tpl")
        self.left = sum(d * k for d, k in zip(self.low, (stats["l1"], stats["l2"], stats["l3up"]), strict=True))
        self.maps: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def drop(self) -> None:
        """Delete the files; scores can't be made any more."""
        shutil.rmtree(self.folder, ignore_errors=True)

    def table_in(self, name: str, dtype: np.dtype) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.folder}/{name}"
            self.maps[name] = np.memmap(path, dtype=dtype, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
        return self.maps[name]

    def counts_in(self, name: str) -> tuple[np.ndarray, ...]:
        if name not in self.maps:
            path = f"{self.folder}/{name}"
            if not os.path.exists(path):
                self.maps[name] = (np.zeros(0, U), np.zeros(0, np.uint8), np.zeros(0, U), np.zeros(0, U))
            else:
                raw = np.memmap(path, dtype=np.uint8, mode="r")
                k, o = (int(x) for x in raw[:16].view("<u8"))
                cut_at = np.cumsum([16, 8 * k, 8 * o, 8 * o])
                self.maps[name] = (raw[16 : cut_at[1]].view("<u8"), raw[cut_at[3] :], raw[cut_at[1] : cut_at[2]].view("<u8"), raw[cut_at[2] : cut_at[3]].view("<u8"))
        return self.maps[name]

    def look(self, keys: np.ndarray, kind: str = "words", dtype: np.dtype = _WORD) -> np.ndarray:
        """Entries of distinct sorted keys; zeros where there is none."""
        out = np.zeros(keys.size, dtype=dtype)
        to = bucket_of(keys, self.shards)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(self.shards + 1))
        for b in np.flatnonzero(np.diff(edge)):
            mine, have = order[edge[b] : edge[b + 1]], self.table_in(f"{kind}-{b}", dtype)
            if have.size:
                column = have["word"]
                at = np.minimum(np.searchsorted(column, keys[mine]), have.size - 1)
                on = column[at] == keys[mine]
                out[mine[on]] = have[at[on]]
        return out

    def counts(self, kind: str, to: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted keys in the shards ``to``."""
        out = np.zeros(keys.size)
        order = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)):
            mine = order[edge[s] : edge[s + 1]]
            column, small, over, large = self.counts_in(f"{kind}-{s}")
            if not column.size:
                continue
            at = np.minimum(np.searchsorted(column, keys[mine]), column.size - 1)
            on = column[at] == keys[mine]
            c = small[at[on]].astype(np.float64)
            many = np.flatnonzero(c == 255)
            if many.size:
                c[many] = large[np.searchsorted(over, keys[mine[on][many]])]
            out[mine[on]] = c
        return out

    def single(self, cc: np.ndarray) -> np.ndarray:
        """p1 from continuation counts."""
        if not self.types:
            return np.full(cc.size, 1 / (self.v + 1))
        cc = cc.astype(np.float64)
        d = np.select([cc == 0, cc == 1, cc == 2], [0.0, self.low[0], self.low[1]], self.low[2])
        return (cc - d + self.left / (self.v + 1)) / self.types

    def score(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, the base score, the model's log10 probability."""
        distinct, which = np.unique(np.append(words, BEGIN), return_inverse=True)
        entry = self.look(distinct)
        begin, which = which[-1], which[:-1]
        prior = which.copy()
        prior[1:] = which[:-1]
        prior[at[:-1]] = begin
        v = before(words, at)
        keys, first, back = np.unique(pair(v, words), return_index=True, return_inverse=True)
        c = self.counts("pairs", shard_of(v[first], keys, self.hot, self.shards), keys)
        p = interpolated(c, entry[prior[first]], self.high, self.single(entry["cc"][which[first]]))
        if self.order == 3:
            lower, u = p[back], before(v, at)
            context = pair(u, v)
            keys, first, back = np.unique(pair(context, words), return_index=True, return_inverse=True)
            c = self.counts("triples", triple_shard(context[first], keys, crowded(u[first], v[first], self.hot), self.shards), keys)
            known, at_context = np.unique(context[first], return_inverse=True)
            p = interpolated(c, self.look(known, "contexts", _CONTEXT)[at_context], self.top, lower[first])
        count = entry["c"].astype(np.float64)
        base = np.log10((count + 1) / (self.n + self.v + 1))
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in ((count > 0)[which], base[which], np.log10(p)[back])]
        known, based, scored = (x[at[1:]] - x[at[:-1]] for x in sums)
        return known.astype(np.int64), based, scored


def interpolated(c: np.ndarray, context: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """The discounted share of each count in its context, and what is spared times the lower order; that alone where the context is unknown."""
    total = context["t"].astype(np.float64)
    d = np.select([c == 0, c == 1, c == 2], [0.0, *discount[:2]], discount[2])
    spare = sum(x * context[n] for x, n in zip(discount, ("n1", "n2", "n3"), strict=True))
    return np.where(total > 0, (c - d + spare * lower) / np.maximum(total, 1), lower)


def local_path(uri: str) -> str:
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"memory maps need a mounted shared folder, not {uri}; give model_dir")
    return uri.removeprefix("file://")


def fit(train: DataFrame, order: int = 3, model_dir: str | None = None) -> Model:
    """Count ``train(text)`` and write the model to a new folder in ``model_dir`` or the shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = train.sparkSession
    folder = local_path(f"{model_dir}/kneser-ney-{uuid.uuid4().hex}" if model_dir else new_folder(spark, "kneser-ney"))
    text = train.select("text")
    shards = max(8, -(-(text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))

    def meet(df: DataFrame) -> DataFrame:
        return df.repartition(shards, "bucket").sortWithinPartitions("bucket")

    words = cut(meet(text.mapInArrow(_count_words(shards), _BLOCK)).mapInArrow(_add_words, _BLOCK), "word-counts")
    n, v = words.mapInArrow(_sizes, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    hot = np.array([r.word & (1 << 64) - 1 for r in words.mapInArrow(_frequent(max(1, -(-n // (8 * shards)))), "word long").collect()], dtype=U)
    if order == 3:
        counted = meet(text.mapInArrow(_count_triples(shards, hot), _BLOCK)).mapInArrow(_add_triples(folder, shards, hot), _BLOCK)
    else:
        counted = text.mapInArrow(_count_pairs(shards, hot), _BLOCK)
    pairs = meet(counted).mapInArrow(_add_pairs(folder, shards), _BLOCK)
    stats = meet(words.unionByName(pairs)).mapInArrow(_finish_words(folder), ", ".join(f"{x} long" for x in _STATS))
    found = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _STATS)).first()
    return Model(folder, shards, hot, n, v, order, found.asDict())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, held_out, text)`` -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch, "text", SCORED):
                words, at = tokens(part.column("text"))
                known, base, scored = m.score(words, at)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(n.size, m.n)), pa.array(base), pa.array(scored), pa.array(10.0 ** (-scored / n))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
