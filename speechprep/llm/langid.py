"""Language ID: multinomial naive Bayes over hashed character 1- to 3-grams.

Training counts every n-gram of every training text in Spark: tasks send one small count block per
language and range of buckets.  Blocks are added up in two levels, first in ``SALTS`` groups by task
number and then these, each as a running sum over a sorted stream, so that no task gathers what
all tasks have sent.  The matrix of log probabilities (``BUCKETS`` x languages) is broadcast; its
size is fixed by those two, and more than ``MOST_LANGUAGES`` learned values are refused.  Scoring
gathers each text's cells of the matrix and adds them up in numpy, whole texts at a time.

Edge cases: a null text and one without a letter are ``und`` with score 0; ties go to the first
language in order; without training rows every text is ``und``; equal rows get equal results; columns
that pass through ``predict`` may have any names but those of its two results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.arrays import chunks, tables
from speechprep.llm.store import fresh

BUCKETS, GRAMS, PRIOR, MOST_LANGUAGES, BLOCK = 1 << 14, 3, 0.5, 512, 1 << 11
UNKNOWN = "und"
#: First-level groups of each count block, and bytes of text worked at once.
SALTS, WORKED = 64, 1 << 18


def _letters() -> np.ndarray:
    """Letters by code point: one table, made once in each worker."""
    mine = tables("langid")
    if "letters" not in mine:
        mine["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return mine["letters"]


def grams(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 1, 2, 3 the buckets of all n-grams and the offsets of each text's; and whether a text has a letter.

    Texts are lower-cased; whatever is no letter becomes one blank, and blanks side by side are one.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    size = pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer(b"".join(x.as_buffer() for x in lowered).decode("utf-8").encode("utf-32-le"), dtype="<u4")
    letter = _letters()[code]
    doc = np.repeat(np.arange(size.size, dtype=np.int32), size)
    has = np.bincount(doc[letter], minlength=size.size) > 0
    keep = letter.copy()
    if code.size:
        keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
        keep[0] = True
    code, doc = np.where(letter, code, np.uint32(32))[keep], doc[keep]
    out, h, every = [], np.zeros(code.size, dtype=np.uint32), np.arange(size.size + 1)
    for n in range(1, GRAMS + 1):
        h = (h[: max(code.size - n + 1, 0)] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x9E3779B1))
        here = doc[: h.size]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        mixed = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 14)
        whole = here == doc[n - 1 :]
        out.append((mixed[whole], np.searchsorted(here[whole], every)))
    return out, has


_BLOCKS = "lang string, block int, salt int, docs long, counts array<long>"
_BLOCK_SCHEMA = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("salt", pa.int32()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part in chunks(batch, "text", WORKED):
            found, has = grams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in set(langs[has]):
                which = (langs == lang) & has
                docs[lang] = docs.get(lang, 0) + int(which.sum())
                for index, at in found:
                    got = np.bincount(index[np.repeat(which, np.diff(at))], minlength=BUCKETS)
                    total[lang] = total[lang] + got if lang in total else got
    salt = TaskContext.get().partitionId() % SALTS
    for lang, counts in total.items():
        for b in range(BUCKETS // BLOCK):
            yield pa.RecordBatch.from_pylist([{"lang": lang, "block": b, "salt": salt, "docs": docs[lang] if b == 0 else 0, "counts": counts[b * BLOCK : (b + 1) * BLOCK]}], schema=_BLOCK_SCHEMA)


def _running_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of one (language, block, salt) become one: only the sum so far is held."""
    now, docs, counts = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"lang": now[0], "block": now[1], "salt": now[2], "docs": docs, "counts": counts}], schema=_BLOCK_SCHEMA)

    for batch in batches:
        cells = batch.column("counts")
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "salt")), strict=True)):
            if key != now:
                if now is not None:
                    yield out()
                now, docs, counts = key, 0, np.zeros(BLOCK, dtype=np.int64)
            docs += batch.column("docs")[i].as_py()
            counts = counts + cells[i].values.to_numpy()
    if now is not None:
        yield out()


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """``rows(text, lang)`` -> languages in order, and the matrix of log probabilities; its last row holds the priors."""
    parts = rows.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, _BLOCKS)
    for key in (["lang", "block", "salt"], ["lang", "block"]):
        if len(key) == 2:
            parts = parts.withColumn("salt", F.lit(0))
        parts = parts.repartition(*key).sortWithinPartitions("lang", "block", "salt").mapInArrow(_running_sum, _BLOCKS)
    found = parts.limit(MOST_LANGUAGES * (BUCKETS // BLOCK) + 1).collect()
    langs = sorted({r.lang for r in found})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages to learn")
    counts, docs = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for r in found:
        k = langs.index(r.lang)
        counts[r.block * BLOCK : (r.block + 1) * BLOCK, k] = r.counts
        docs[k] += r.docs
    likely = np.log(counts + PRIOR) - np.log(counts.sum(axis=0) + PRIOR * BUCKETS)
    return langs, np.vstack([likely, np.log(docs / max(docs.sum(), 1) + 1e-300)])


def _sums(found: list[tuple[np.ndarray, np.ndarray]], column: np.ndarray, n: int) -> np.ndarray:
    """Sum of each text's cells of ``column``."""
    total = np.zeros(n)
    for index, at in found:
        some = np.flatnonzero(np.diff(at))
        if some.size:
            total[some] += np.add.reduceat(column[index], at[some])
    return total


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, *kept: Column, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``text`` -> the columns ``kept``, then the two columns ``named``: the language and its posterior."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    names = docs.select(*kept).columns
    source = docs.select(*kept, F.col("text").alias(*fresh(names, "#text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = model.value
        columns = np.ascontiguousarray(matrix[:-1].T)
        for batch in batches:
            for part in chunks(batch, len(names), WORKED):
                found, has = grams(part.column(len(names)))
                n = part.num_rows
                if langs:
                    total = np.stack([_sums(found, columns[k], n) + matrix[-1, k] for k in range(len(langs))], axis=1)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    pred = [langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                    score = np.where(has, share, 0.0)
                else:
                    pred, score = [UNKNOWN] * n, np.zeros(n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, *named])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())])
    return source.mapInArrow(run, schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
