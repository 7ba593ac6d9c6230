"""Source divergence audit by chunk factorization.

A document is cut into chunks between ASCII white space, and chunks are counted in place: a task
sends one row for each distinct chunk and language of about ``SLICE_BYTES`` of text, with the chunk's
occurrences in each source.  Rows of a chunk meet in one task, sorted, so each globally distinct chunk is tokenised
once; its terms take over its rows and are summed up by term and source.  Chunks go to tasks by
their letters and digits, so that "The", "the," and "the" meet and what the second shuffle carries is nearly summed up.  White space
is no part of a term, so the terms of a document are those of its chunks.

Several chunks of a document can hold one term, so distinct documents are followed by their numbers:
with each row go the documents that it stands for, until they are as many as a kept term needs,
which nothing takes back.  A document has one source, so those of a term add up over sources.

However frequent a chunk or a term, at most one row for a slice and language of it reaches a task, and
tasks hold a stretch of sorted rows at a time.  Sources of a language are compared in blocks of
``SIDE`` of them: a task holds two blocks' sums, whatever the number of terms, and works only on terms
that one of two sources has; the others all have the same value.

Edge cases: null text, lang and source count as ''; a row is a document, so repeated rows are
documents of their own and doc_id isn't read; texts without terms leave their group with counts of zero; a language without kept
terms has pairs of value 0; ties go by the item's UTF-8 bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.arrays import SPACED, ascii_lower, chunks, flat, runs, span_hash, spans, strings, table
from speechprep.llm.shards import small
from speechprep.llm.store import cut

#: Bytes of terms: those of A-Z, a-z and of whatever is not ASCII.
TERM = table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_DIGIT = table(lambda b: 48 <= b <= 57)
LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Counts under this stay longs when multiplied by UNIT; larger ones are worked out in decimals.
_FITS = (1 << 63) // UNIT - 1
#: Bytes of text counted at once, rows of a batch sent, sorted rows summed up at once, and sources compared at once.
SLICE_BYTES, ROWS, UNITED, SIDE = 20 << 20, 1 << 15, 1 << 16, 256

_ROW = "home int, key string, lang string, numbers array<int>, n array<long>, docs array<long>"
_KEPT = "lang string, number int, term string, n long, of_lang long, first boolean"


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts as codes of a dictionary, and each one's text."""
    buf, offsets = flat(texts)
    start, end, doc = spans(SPACED[buf], offsets)
    return strings(buf, start, end).dictionary_encode(), doc


def _homes(chunk: pa.Array) -> np.ndarray:
    """A number for each chunk that hangs on its letters and digits alone; -1 without a letter."""
    buf, at = flat(chunk)
    kept, letters = TERM[buf] | _DIGIT[buf], np.concatenate([[0], np.cumsum(TERM[buf])])[at]
    inside = np.concatenate([[0], np.cumsum(kept)])[at]
    home = (span_hash(ascii_lower(buf[kept]), inside[:-1], inside[1:]) >> np.uint64(33)).astype(np.int32)
    return np.where(letters[1:] > letters[:-1], home, np.int32(-1))


def _lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=None if null is None else pa.array(null))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(keys[0].size, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if first.size else np.zeros(0, np.int64)


def _counted(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40  # numbers of documents
        for batch in batches:
            for part in chunks(batch, "text", SLICE_BYTES):
                coded, doc = _coded(part.column("text"))
                lang, number = part.column("lang").dictionary_encode(), part.column("number").to_numpy()
                by = int(number.max()) + 1
                group = lang.indices.to_numpy().astype(np.int64) * by + number
                order = np.argsort(group, kind="stable")  # documents are numbered group by group
                rank = np.empty(order.size, dtype=np.int64)
                rank[order] = np.arange(order.size)
                group = group[order]
                pair, n = np.unique(coded.indices.to_numpy().astype(np.int64) * order.size + rank[doc], return_counts=True)
                code, doc = pair // order.size, pair % order.size
                some = np.flatnonzero(_homes(coded.dictionary)[code] >= 0)
                code, doc, n = code[some], doc[some], n[some]
                own = group[doc]
                units = _firsts(code, own)  # a chunk in a source
                total, own = _sums(n, units), own[units]
                rows = _firsts(code[units], own // by)  # and in a language
                numbers, sources, many = (own % by).astype(np.int32), np.diff(np.append(rows, units.size)), np.diff(np.append(units[rows], code.size))
                code, lang_of, home = code[units[rows]], own[rows] // by, _homes(coded.dictionary)[code[units[rows]]]
                listed, at, docs_at = np.where(many < least, many, 0), np.append(rows, units.size), np.append(units[rows], doc.size)
                for i in range(0, rows.size, ROWS):
                    j = min(i + ROWS, rows.size)
                    docs = _lists(serial + doc[runs(docs_at[i:j], docs_at[i:j] + listed[i:j])], listed[i:j], many[i:j] >= least)
                    columns = [pa.array(home[i:j]), coded.dictionary.take(pa.array(code[i:j])).cast(pa.string()), lang.dictionary.take(pa.array(lang_of[i:j])), *[_lists(x[at[i] : at[j]], sources[i:j]) for x in (numbers, total)], docs]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROW.split(", ")])
                serial += part.num_rows

    return run


def _terms(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of chunks: the distinct terms, and for each row and term of its chunk the row and the term."""
    buf, at = flat(coded.dictionary)
    start, end, owner = spans(TERM[buf], at)
    terms = strings(ascii_lower(buf), start, end).dictionary_encode()
    first = np.searchsorted(owner, np.arange(len(coded.dictionary) + 1))
    code = coded.indices.to_numpy()
    a, b = first[code], first[code + 1]
    return terms.dictionary, np.repeat(np.arange(code.size), b - a), terms.indices.to_numpy()[runs(a, b)]


def _summed(rows: pa.Table, least: int, split: bool, final: bool) -> pa.RecordBatch:
    """Rows of whole keys, summed up by key and language; keys are tokenised if ``split``, and terms with too few documents go if ``final``."""
    coded = rows.column("key").combine_chunks().cast(pa.large_string()).dictionary_encode()
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    keys, row, key = _terms(coded) if split else (coded.dictionary, np.arange(len(coded)), coded.indices.to_numpy())
    spot, unit = np.unique(key.astype(np.int64) * len(lang.dictionary) + lang.indices.to_numpy()[row], return_inverse=True)
    key, own = spot // len(lang.dictionary), spot % len(lang.dictionary)

    def cells(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the lists of all rows and terms, each one's unit, and which rows' lists are null."""
        x = rows.column(name).combine_chunks()
        at = x.offsets.to_numpy().astype(np.int64)
        return x.values.to_numpy()[runs(at[row], at[row + 1])], np.repeat(unit, at[row + 1] - at[row]), x.is_null().to_numpy(zero_copy_only=False)

    number, of, _ = cells("numbers")
    order = np.lexsort((number, of))
    number, of = number[order], of[order]
    first = _firsts(of, number)
    total, number, of = _sums(cells("n")[0][order], first), number[first], of[first]
    doc, held, null = cells("docs")
    enough = np.zeros(spot.size, dtype=bool)
    enough[unit[null[row]]] = True
    order = np.lexsort((doc, held))
    doc, held = doc[order], held[order]
    first = _firsts(held, doc)
    doc, held = doc[first], held[first]
    many = np.bincount(held, minlength=spot.size)
    enough |= many >= least
    if final:
        first = _firsts(of)
        of_lang, kept = _sums(total, first)[of], enough[of]
        is_first = np.zeros(of.size, dtype=bool)
        is_first[first] = True
        columns = [lang.dictionary.take(pa.array(own[of][kept])), pa.array(number[kept]), keys.take(pa.array(key[of][kept])).cast(pa.string()), *[pa.array(x[kept]) for x in (total, of_lang, is_first)]]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _KEPT.split(", ")])
    sources = np.bincount(of, minlength=spot.size)
    columns = [pa.array(np.zeros(spot.size, np.int32)), keys.take(pa.array(key)).cast(pa.string()), lang.dictionary.take(pa.array(own)), _lists(number, sources), _lists(total, sources), _lists(doc[~enough[held]], np.where(enough, 0, many), enough)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROW.split(", ")])


def _sorted_sums(least: int, split: bool, final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows in stretches of whole keys, or of one long key that is summed up as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) < UNITED:
                continue
            rows = pa.concat_tables(held)
            key = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield _summed(rows.slice(0, whole), least, split, final)
                held = [rows.slice(whole)]
            elif not split:
                held = [pa.Table.from_batches([_summed(rows, least, False, False)])]
            else:  # one chunk only: its sum is as good as whole
                yield _summed(rows, least, split, final)
                held = []
        if held:
            yield _summed(pa.concat_tables(held), least, split, final)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def numbered_sources(docs: DataFrame) -> DataFrame:
    """(lang, source, number, blocks): the sources of each language in order, and how many blocks of ``SIDE`` they make."""
    by_lang = Window.partitionBy("lang")
    number, blocks = F.row_number().over(by_lang.orderBy("source")) - 1, F.ceil(F.count("*").over(by_lang) / SIDE)
    return _texts(docs).select("lang", "source").distinct().select("lang", "source", number.cast("int").alias("number"), blocks.cast("int").alias("blocks"))


def kept_terms(docs: DataFrame, sources: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, number, term, n, of_lang, first) of all terms in at least ``least_docs`` documents of a language: occurrences in a source and in the language; ``first`` marks a row of each term."""
    texts = _texts(docs).join(small(sources.select("lang", "source", "number")), ["lang", "source"]).select("lang", "number", "text")
    by_chunk = texts.mapInArrow(_counted(least_docs), _ROW).repartition("home").sortWithinPartitions("home", "key")
    by_term = by_chunk.mapInArrow(_sorted_sums(least_docs, True, False), _ROW).repartition("key").sortWithinPartitions("key")
    return by_term.mapInArrow(_sorted_sums(least_docs, False, True), _KEPT)


def likely(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / (total + terms)), exactly."""
    big = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))
    return F.when(n < _FITS, F.call_function("div", (n + 1) * UNIT, total + terms)).otherwise(big) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


_PAIRED = "lang string, left int, right int, i int, j int, value long, touched long"
#: Cells of a matrix of terms by sources that are worked at once.
CELLS = 1 << 20


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language, blocks and term -> for each pair of sources of the two blocks the values' sum over the terms of either, and how many these are.

    The first row of two blocks has no term, but ``unseen``, the p of each of their sources for a term that it lacks.
    """
    now, base, value, touched, held = None, None, None, None, []

    def work(rows: pa.Table) -> None:
        if not rows.num_rows:
            return
        i, p = (rows.column(c).to_numpy() for c in ("place", "p"))
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        seen = np.zeros((int(term.max()) + 1, base.size), dtype=bool)
        seen[term, i] = True
        ps = np.broadcast_to(base, seen.shape).copy()
        ps[term, i] = p
        order = np.argsort(i, kind="stable")
        i, p, term = i[order], p[order], term[order]
        edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        for a, b in zip(edge, np.append(edge[1:], i.size), strict=True):
            k, mine, others, lacks = i[a], p[a:b, None], ps[term[a:b]], ~seen[term[a:b]]
            square = (mine - others) ** 2
            value[k] += (square // others).sum(axis=0)
            value[:, k] += np.where(lacks, square // mine, 0).sum(axis=0)
            touched[k] += b - a
            touched[:, k] += lacks.sum(axis=0)

    def out() -> pa.RecordBatch:
        work(pa.concat_tables(held) if held else _NO_ROWS)
        i, j = np.nonzero(touched)
        columns = [pa.array([now[0]] * i.size, pa.string()), *[pa.array(np.full(i.size, x, np.int32)) for x in now[1:]], *[pa.array(x.astype(np.int32)) for x in (i, j)], pa.array(value[i, j]), pa.array(touched[i, j])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PAIRED.split(", ")])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "left", "right")), strict=True))
        edge = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
        for a, b in zip(edge, edge[1:], strict=False):
            if keys[a] != now:
                if now is not None:
                    yield out()
                now, held = keys[a], []
                base = np.array(batch.column("unseen")[a].as_py(), dtype=np.int64)
                value, touched = (np.zeros((base.size, base.size), np.int64) for _ in range(2))
                a += 1
            step = max(CELLS // base.size, 1)
            for at in range(a, b, step):
                held.append(pa.Table.from_batches([batch.slice(at, min(step, b - at)).select(["place", "term", "p"])]))
                if sum(x.num_rows for x in held) >= step:  # the last term may go on: its rows stay
                    rows = pa.concat_tables(held)
                    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
                    whole = int(np.flatnonzero(term != term[-1])[-1]) + 1 if term[0] != term[-1] else 0
                    work(rows.slice(0, whole))
                    held = [rows.slice(whole)]
    if now is not None:
        yield out()


_NO_ROWS = pa.table({"place": pa.array([], pa.int32()), "term": pa.array([], pa.string()), "p": pa.array([], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from each other one, and its ``top`` terms over the language's share."""
    sources = cut(numbered_sources(docs), "sources")
    rows = cut(kept_terms(docs, sources, least_docs), "terms")
    langs = rows.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = rows.groupBy("lang", "number").agg(F.sum("n").alias("total"))
    groups = sources.join(totals.hint("merge"), ["lang", "number"], "left").join(langs.hint("merge"), "lang", "left")
    groups = groups.select("lang", "source", "number", "blocks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    unseen = F.when(F.col("terms") > 0, likely(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(1)
    groups = cut(groups.withColumn("unseen", unseen), "groups")
    shares = rows.join(small(groups), ["lang", "number"]).withColumn("p", likely(F.col("n"), F.col("total"), F.col("terms")))
    q = likely(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    over = shares.withColumn("q", q).filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = over.withColumn("rank", ranked).filter(F.col("rank") <= top)
    return _of_pairs(shares, groups).withColumn("rank", ranked).unionByName(terms)


def _of_pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Each source of a language against each other one, over all kept terms."""
    tasks = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, meets = F.floor(F.col("number") / SIDE).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")
    # a row goes to each meeting of its block with another; its place counts from the first source of the left block
    place = F.col("number") % SIDE + F.when(F.col("block") > F.col("other"), SIDE).otherwise(0)
    sent = shares.select("lang", block.alias("block"), "number", "term", "p", meets.alias("other")).select("lang", left, right, "term", place.cast("int").alias("place"), "p", F.lit(None).cast("array<long>").alias("unseen"), F.pmod(F.xxhash64("term"), F.lit(tasks)).cast("int").alias("to"))
    listed = groups.groupBy("lang", "blocks", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "unseen"))), lambda x: x["unseen"]).alias("own"))
    own = listed.select("lang", "block", "own", meets.alias("other")).filter("block <= other")
    others = listed.select("lang", F.col("block").alias("other"), F.col("own").alias("theirs"))
    both = F.when(F.col("block") == F.col("other"), F.col("own")).otherwise(F.concat("own", "theirs"))
    heads = own.join(others.hint("merge"), ["lang", "other"]).select("lang", left, right, F.lit(None).cast("string").alias("term"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("p"), both.alias("unseen"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("to"))
    dealt = sent.unionByName(heads).repartitionById(tasks, F.col("to")).sortWithinPartitions("lang", "left", "right", F.col("term").asc_nulls_first()).drop("to")
    sums = dealt.mapInArrow(_pairs, _PAIRED).filter(f"left = right or (i < {SIDE}) <> (j < {SIDE})")  # two sources of one block meet once only
    number = lambda c: F.when(F.col(c) < SIDE, F.col("left") * SIDE + F.col(c)).otherwise(F.col("right") * SIDE + F.col(c) - SIDE).cast("int")
    sums = sums.select("lang", number("i").alias("a"), number("j").alias("b"), "value", "touched").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched"))
    a = groups.select("lang", "source", F.col("number").alias("a"), F.col("unseen").alias("p"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("unseen").alias("q"))
    pairs = a.join(b.hint("merge"), "lang").filter("a <> b").join(sums.hint("merge"), ["lang", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("touched", F.lit(0))) * apart(F.col("p"), F.col("q"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + rest).cast("long").alias("value"))
