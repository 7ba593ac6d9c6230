"""Substring dedup by sliding sentence spans.

A sentence ends at a line break or at ``. ! ?`` before white space; one of more than ``PIECE``
words is also cut after each word whose hash divides by ``CUT``, so that a passage has the same
parts behind another beginning, too.  At 51 words the first and last such cut inside a passage leave
less than ``LEAST`` words between them in about one of 10,000 cases; one word over and over has no
cut, and a repeat of less than ``LEAST`` words stays.  Every
run of ``RUN`` consecutive sentences, or of as many more as ``LEAST`` words take, is hashed: 96 bits of XXH3 over its
lower-cased words, with sentences told apart, so equal hashes stand for equal words (1e13 spans make fewer
than 0.001 equal pairs by chance).  The occurrence with
the least (doc_id, row hash, position) is the first; the sentences of all others go.  So sentences that a
text has in common with an earlier place go, if there are several of them.

Each task first settles its own rows: one entry per distinct span goes on, so a span that a third
of all rows hold adds one entry per task to its bucket.  Buckets meet on the span's hash; what is
removed goes on in packs by the hash of its row, is put together row by row, and is joined to the texts.

Edge cases: null text stays null; a text without words is unchanged; repeated rows (same doc_id and text)
count as one row and get the same result; a null doc_id sorts first; removal may leave an empty
text; an empty table stays empty.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.arrays import U, chunks, flat, mix, prose_mask, span_hash, spans, tables
from speechprep.llm.store import fresh

RUN, LEAST, PIECE, CUT = 2, 24, 8, 3
_DIGEST = np.dtype([("hash", "<u8"), ("more", "<u4")])
#: Spans that a task holds before it sends them on, and bytes of text whose spans make a bucket.
HELD, BUCKET_BYTES = 2_000_000, 2 << 20


def same_character(buf: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the characters that begin at bytes ``at`` of the lower-cased ``buf`` begin in ``raw``: lower-casing keeps their number, not their lengths."""
    a, b = (buf & 0xC0) != 0x80, (raw & 0xC0) != 0x80
    if np.array_equal(a, b):
        return at
    return np.flatnonzero(b)[np.cumsum(a)[at] - 1]


class Sentences:
    """Sentences of a chunk of texts: byte bounds of their words, word counts, plain words and document numbers."""

    def __init__(self, texts: pa.Array):
        raw, self.offsets = flat(texts)
        self.raw = raw
        buf, offsets = flat(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        mask = prose_mask(buf)
        start, end, doc = spans(mask, offsets)
        words = span_hash(buf, start, end)
        stop = np.zeros(buf.size + 1, dtype=bool)
        if buf.size:
            space = (buf == 32) | ((buf >= 9) & (buf <= 13))
            mark = (buf == 46) | (buf == 33) | (buf == 63)
            stop[:-1] = buf == 10
            stop[1:-1] |= mark[:-1] & space[1:]
        ends = np.cumsum(stop)
        new = np.ones(start.size, dtype=bool)
        if start.size:
            new[1:] = (doc[1:] != doc[:-1]) | (ends[start[1:]] != ends[start[:-1]])
        sentence = np.cumsum(new) - 1
        long = np.bincount(sentence)[sentence] > PIECE if start.size else new
        new[1:] |= ((words % U(CUT) == 0) & long)[:-1]
        first = np.flatnonzero(new)
        last = np.append(first, start.size)[1:]
        self.doc = doc[first]
        self.words = last - first
        # all words one after the other, each with a blank behind it, a sentence's last one with a line break
        size = end - start
        to = np.concatenate([[0], np.cumsum(size + 1)])
        plain = np.full(to[-1], 32, dtype=np.uint8)
        plain[np.arange(to[-1] - size.size) + np.repeat(np.arange(size.size), size)] = buf[mask]
        plain[to[last] - 1] = 10
        self.plain, self.plain_at = plain.tobytes(), to[np.append(first, start.size)]
        self.start = same_character(buf, raw, start[first])
        self.at = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def ends(self, i: np.ndarray) -> np.ndarray:
        """Where the run from each sentence ends: after RUN sentences, or the more that LEAST words take."""
        total = np.concatenate([[0], np.cumsum(self.words)])
        return np.maximum(i + RUN, np.searchsorted(total, total[i] + LEAST))

    def digests(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """96-bit hashes of the sentences from each of ``i`` up to ``j``."""
        view = memoryview(self.plain)
        both = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(self.plain_at[i].tolist(), self.plain_at[j].tolist(), strict=True)])
        wide = np.frombuffer(both, dtype="<u8").reshape(-1, 2)
        out = np.empty(i.size, dtype=_DIGEST)
        out["hash"], out["more"] = wide[:, 0], wide[:, 1] & U(0xFFFFFFFF)
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First sentence and hash of every run that lies within its text."""
        i = np.arange(self.doc.size)
        j = self.ends(i)
        inside = j <= self.at[self.doc + 1]
        return i[inside], self.digests(i[inside], j[inside])


def row_keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id with null as the least value, and a hash of doc_id and text."""
    ids = pc.fill_null(part.column("doc_id").cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)
    buf, at = flat(part.column("text"))
    view = memoryview(buf)
    texts = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=U)
    return ids, mix(texts + mix(ids.astype(U), 11)).astype(np.int64)


_SENT = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_ENTRY = np.dtype([*((name, _DIGEST[name]) for name in _DIGEST.names), ("id", "<i8"), ("row", "<i8"), ("at", "<i4")])


def _ranges(to: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The numbers in the sorted ``to`` and where each begins and ends, in memory that hangs on ``to`` alone."""
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))[: to.size]
    edge = np.append(first, to.size).tolist()
    return to[first], list(zip(edge[:-1], edge[1:], strict=True))


def _packed(row: np.ndarray, at: np.ndarray, packs: int) -> pa.RecordBatch:
    """Positions of removed runs in one cell for each of ``packs`` hash ranges of rows, numbered -1, -2, ...: rows, how many each, positions."""
    to = (mix(row.astype(U), 61) % U(packs)).astype(np.int64)
    order = np.lexsort((at, row, to))
    row, at, to = row[order], at[order].astype("<i4"), to[order]
    new = np.concatenate([[True], row[1:] != row[:-1]])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, row.size)).astype("<i4")
    ends = np.append(first, row.size)
    some, edge = _ranges(to[first])
    cells = [np.int64(b - a).tobytes() + row[first[a:b]].tobytes() + many[a:b].tobytes() + at[ends[a] : ends[b]].tobytes() for a, b in edge]
    return pa.RecordBatch.from_arrays([pa.array((-1 - some).astype(np.int32)), pa.array(cells, pa.binary())], schema=_SENT)


def _unpacked(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(cell[:8], "<i8")[0])
    row, many = np.frombuffer(cell[8 : 8 + 8 * n], "<i8"), np.frombuffer(cell[8 + 8 * n : 8 + 12 * n], "<i4")
    return np.repeat(row, many), np.frombuffer(cell[8 + 12 * n :], "<i4")


def _settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First occurrence of each hash, and the rows and positions of all others."""
    e = e[np.lexsort((e["at"], e["row"], e["id"], e["more"], e["hash"]))]
    new = np.ones(e.size, dtype=bool)
    new[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["more"][1:] != e["more"][:-1])
    first = e[new]
    other = ~new
    if e.size:  # an identical row's run is the same place, not another one
        lead = first[np.cumsum(new) - 1]
        other &= (lead["row"] != e["row"]) | (lead["at"] != e["at"])
    return first, e["row"][other], e["at"][other]


def _gather(buckets: int, packs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables("substring")  # lets those of other operators go
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            first, row, at = _settle(np.concatenate(held))
            held.clear()
            if row.size:
                yield _packed(row, at, packs)
            to = (first["hash"] % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            first, to = first[order], to[order]
            some, edge = _ranges(to)
            cells = [first[a:b].tobytes() for a, b in edge]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells, pa.binary())], schema=_SENT)

        size = 0
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, rows = row_keys(part)
                s = Sentences(part.column("text"))
                i, h = s.runs()
                e = np.empty(i.size, dtype=_ENTRY)
                e["hash"], e["more"], e["id"], e["row"], e["at"] = h["hash"], h["more"], ids[s.doc[i]], rows[s.doc[i]], i - s.at[s.doc[i]]
                held.append(e)
                size += i.size
                if size >= HELD:
                    yield from send()
                    size = 0
        if held:
            yield from send()

    return run


def _meet(packs: int):
    """All entries of each bucket together; packs pass through.  Rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        gone: list[tuple[np.ndarray, np.ndarray]] = []

        def out(last: bool = False) -> Iterator[pa.RecordBatch]:
            if held:
                gone.append(_settle(np.concatenate(held))[1:])
                held.clear()
            if last or sum(row.size for row, _ in gone) >= HELD:
                row, at = (np.concatenate([np.zeros(0, "<i8"), *x]) for x in zip(*gone, strict=True)) if gone else (np.zeros(0, "<i8"),) * 2
                if row.size:
                    yield _packed(row, at, packs)
                gone.clear()

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            if (passed := bucket < 0).any():
                yield batch.filter(pa.array(passed)).cast(_SENT)
            for i in np.flatnonzero(~passed):
                if bucket[i] != now:
                    yield from out()
                    now = bucket[i]
                held.append(np.frombuffer(batch.column("data")[int(i)].as_py(), dtype=_ENTRY))
        yield from out(True)

    return run


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of each number together: one row for each text, with all its positions."""
    held, now = [], None

    def out() -> Iterator[pa.RecordBatch]:
        row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        keep = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
        row, at = row[keep], at[keep]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array([x.tobytes() for x in np.split(at, first[1:])], pa.binary())], names=["row", "gone"])

    for batch in batches:
        for bucket, cell in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if bucket != now and held:
                yield from out()
            now = bucket
            held.append(_unpacked(cell))
    if held:
        yield from out()


def _keyed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(row_keys(part)[1])], names=names)

    return run


def _cut(names: list[str], text_at: int, out_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_at):
                s = Sentences(part.column(text_at))
                gone = np.zeros(s.doc.size + 1, dtype=np.int64)
                for d, cell in enumerate(part.column(len(names)).to_pylist()):
                    if cell:
                        i = s.at[d] + np.frombuffer(cell, dtype="<i4")
                        np.add.at(gone, i, 1)
                        np.add.at(gone, s.ends(i), -1)
                out = np.cumsum(gone)[: s.doc.size] > 0
                keep = np.ones(s.raw.size + 1, dtype=np.int64)
                n_out = np.bincount(s.doc[out], minlength=part.num_rows)
                texts = part.column(text_at).to_pylist()
                for d in np.flatnonzero(n_out):
                    a, b = s.at[d], s.at[d + 1]
                    raw = s.raw[s.offsets[d] : s.offsets[d + 1]].tobytes()
                    # a sentence reaches from its first word to the next one's; what stands before the first stays with it
                    edge = np.append(s.start[a:b] - s.offsets[d], len(raw))
                    edge[0] = 0
                    texts[d] = b"".join(raw[edge[i] : edge[i + 1]] for i in np.flatnonzero(~out[a:b])).decode("utf-8", "ignore").strip()
                text = pa.array(texts, pa.string())
                columns = [text if i == text_at else part.column(i) for i in range(len(names))]
                counts = [pa.array(np.diff(s.at)), pa.array(n_out.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *counts], names=out_names)

    return run


def remove_repeats(docs: DataFrame, counts: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cut, and two more named by ``counts``: sentences before, and removed."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    packs = max(8, buckets // 4)
    sent = docs.select("doc_id", "text").mapInArrow(_gather(buckets, packs), "bucket int, data binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(packs), "bucket int, data binary")
    names = [f.name for f in docs.schema]
    row, at, gone = fresh(names, "#row", "#at", "#gone")
    found = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_row, "row long, gone binary").select(F.col("row").alias(at), F.col("gone").alias(gone))
    keyed = docs.mapInArrow(_keyed([*names, row]), T.StructType([*docs.schema.fields, T.StructField(row, T.LongType())]))
    joined = keyed.join(found.hint("shuffle_hash"), F.col(row) == F.col(at), "left").select(*[F.col(f"`{c}`") for c in names], gone)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return joined.mapInArrow(_cut(names, names.index("text"), [*names, *counts]), schema)
