"""Vectorised word work on Arrow string columns, used inside ``mapInArrow`` tasks.

A chunk of texts is one byte buffer plus document offsets.  Words are byte spans found with a
256-entry table, and a span's 64-bit hash comes from prefix sums of ``byte * P**position``, so no
Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


_tables: dict[str, dict] = {}


def tables(owner: str) -> dict:
    """This worker's tables of one operator; what it has kept for others is let go, so a worker that serves several holds one's at a time."""
    for other in [k for k in _tables if k != owner]:
        del _tables[other]
    return _tables.setdefault(owner, {})


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _P), ("inv", _P_INV)):
            x = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"], _powers["inv"]


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of ``column`` each; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the n+1 offsets; a null counts as empty."""
    x = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    _, offsets, data = x.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def table(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Words of prose: ASCII letters and digits, and whatever is not ASCII.
PROSE = table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Words between ASCII white space.
SPACED = table(lambda b: b != 32 and not 9 <= b <= 13)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def prose_mask(buf: np.ndarray) -> np.ndarray:
    """PROSE without the Latin-1 signs (U+0080-U+00BF) and general or CJK punctuation (U+2000-U+207F, U+3000-U+303F)."""
    mask = PROSE[buf]
    if buf.size > 2:
        two = np.flatnonzero(buf[:-1] == 0xC2)
        mask[two] = mask[two + 1] = False
        a, b = buf[:-2], buf[1:-1]
        for three in (np.flatnonzero((a == 0xE2) & ((b == 0x80) | (b == 0x81))), np.flatnonzero((a == 0xE3) & (b == 0x80))):
            mask[three] = mask[three + 1] = mask[three + 2] = False
    elif buf.size == 2 and buf[0] == 0xC2:
        mask[:] = False
    return mask


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs in ``mask``; no run crosses a document's end."""
    n = mask.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, mask[:-1]
    first = mask & (~before | edge[:-1])
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, mask[1:]
    last = mask & (~after | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one after the other."""
    n = end - start
    to = np.cumsum(n)
    return np.arange(to[-1] if n.size else 0) + np.repeat(start - (to - n), n)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The given spans of ``buf``, in order and without overlap, as an Arrow array."""
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    some, edge = end > start, np.zeros(buf.size + 1, dtype=np.int8)
    edge[start[some]] += 1
    edge[end[some]] -= 1
    kept = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return pa.Array.from_buffers(pa.large_string(), start.size, [None, pa.py_buffer(at), pa.py_buffer(buf[kept])])


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power(buf.size + 1)
    total = np.zeros(buf.size + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * power[: buf.size], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def run_hash(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``items[start:end]`` as a sequence, by the same prefix sums."""
    power, inverse = _power(items.size + 1)
    total = np.zeros(items.size + 1, dtype=U)
    np.cumsum(mix(items, 7) * power[: items.size], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def prose_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the n+1 offsets of each text's words."""
    buf, offsets = flat(pc.utf8_lower(texts))
    start, end, doc = spans(prose_mask(buf), offsets)
    return span_hash(buf, start, end), np.searchsorted(doc, np.arange(len(texts) + 1))


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words and each text's n+1 offsets; a shorter text that has words is one run."""
    n = np.diff(at)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(n.size), many)
    start = at[:-1][doc] + np.arange(to[-1]) - to[:-1][doc]
    return run_hash(words, start, np.minimum(start + k, at[1:][doc])), to


def occurrence(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key its running number within its document: equal keys are told apart, so a multiset becomes a set."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(k.size, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.arange(k.size)
    out = np.empty(k.size, dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out
