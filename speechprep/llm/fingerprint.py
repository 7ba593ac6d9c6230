"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text's fingerprint is the sum of one wide vector per paragraph (line), so it doesn't depend on
their order, and a paragraph is put in or taken out by adding or subtracting its vector.  A
paragraph's vector has two parts, both hashed from it:

* ``eq``: 8 lanes modulo 2**32 from four 64-bit hashes of the whole paragraph, each with a seed of its
  own, for equality;
* ``sim``: 120 lanes modulo 2**20 (three to a long, 40 longs) that count, by hash bit, the
  units of the paragraph, and their number.  A unit is a sentence, or if it is long a piece of up to
  ``UNIT_WORDS`` words, of which one over ``WORD_CHARS`` characters (as in scripts without
  blanks) counts as several.  2 * lane - number is a sum of +-1 over units, so
  products of lanes estimate the overlap of two texts: ``likeness`` is their cosine, 1 for equal
  multisets, with a standard error of about 0.09.

Edge cases: a null text counts as empty (one empty paragraph, no unit); two texts with the same
paragraphs have equal fingerprints; likeness with a text without units is 0 unless equal; a text of any length
is hashed whole; rows with a null doc_id come last; equal ids go by their texts' hash; an empty table gives no
rows.  Other columns are ignored by ``edited`` and kept by ``with_next``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.store import fresh

EQ_HASHES, SIM_HASHES = 4, 2
UNIT_WORDS, WORD_CHARS = 8, 8
_LOW32, _LOW20, _LANES, _LOW60 = 0xFFFFFFFF, 0xFFFFF, 1 | 1 << 20 | 1 << 40, (1 << 60) - 1


def fingerprint(text: str) -> tuple[Column, Column]:
    """SQL text expression -> the ``eq`` and ``sim`` arrays; the last cell of ``sim`` is the number of units."""
    paragraphs = rf"split(coalesce({text}, ''), '\n')"
    zeros = ", ".join(["0L"] * 2 * EQ_HASHES)
    steps = ", ".join(f"(a[{2 * k}] + (xxhash64({k}, p) & {_LOW32}L)) & {_LOW32}L, (a[{2 * k + 1}] + shiftrightunsigned(xxhash64({k}, p), 32)) & {_LOW32}L" for k in range(EQ_HASHES))
    eq = F.expr(f"aggregate({paragraphs}, array({zeros}), (a, p) -> array({steps}))")
    sentences = rf"filter(split(coalesce({text}, ''), '\n|(?<=[.!?])[ \t]+|(?<=[。！？])'), s -> s <> '')"
    units = rf"flatten(transform({sentences}, s -> if(length(s) <= {UNIT_WORDS * 6}, array(s), regexp_extract_all(s, '(?:\\S{{1,{WORD_CHARS}}}\\s*+){{1,{UNIT_WORDS}}}+', 0))))"
    parts = []
    for k in range(SIM_HASHES):
        lanes = ", ".join(f"(a[{i}] + (shiftrightunsigned(h, {i}) & {_LANES}L)) & {_LOW60}L" for i in range(20))
        parts.append(f"aggregate(transform(u, s -> xxhash64({100 + k}, s)), array_repeat(0L, 20), (a, h) -> array({lanes}))")
    sim = f"concat({', '.join(parts)}, array(cast(size(u) & {_LOW20} as bigint)))"
    return eq, F.expr(f"element_at(transform(array({units}), u -> {sim}), 1)")


def plus(a: str, b: str, sign: int = 1) -> tuple[Column, Column]:
    """The fingerprint of both texts' paragraphs together; with sign -1, of the first less those of the second.

    ``a``, ``b`` are SQL expressions of structs (eq, sim).
    """
    op = "+" if sign > 0 else "-"
    eq = F.expr(f"zip_with({a}.eq, {b}.eq, (x, y) -> (x {op} y) & {_LOW32}L)")
    sim = F.expr(f"transform(zip_with({a}.sim, {b}.sim, (x, y) -> x {op} y), (x, i) -> if(i < {20 * SIM_HASHES}, x & {_LOW60}L, x & {_LOW20}L))")
    return eq, sim


def as_string(eq: str, sim: str) -> Column:
    """Lanes in order as fixed-width hexadecimal digits."""
    return F.expr(f"lower(concat(array_join(transform({eq}, x -> lpad(hex(x), 8, '0')), ''), array_join(transform({sim}, x -> lpad(hex(x), 15, '0')), '')))")


def signs(sim: str) -> Column:
    """The 120 sums of +-1 behind ``sim``."""
    n = f"element_at({sim}, -1)"
    return F.expr(f"flatten(transform(slice({sim}, 1, {20 * SIM_HASHES}), x -> array(cast(2 * (x & {_LOW20}L) - {n} as double), cast(2 * (shiftright(x, 20) & {_LOW20}L) - {n} as double), cast(2 * (shiftright(x, 40) & {_LOW20}L) - {n} as double))))")


def likeness(a: str, b: str, a_eq: str, b_eq: str) -> Column:
    """Cosine of two arrays made by ``signs``, from 0 to 1; 1 if the ``eq`` lanes are equal."""
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    size = f"sqrt({dot.format(a, a)} * {dot.format(b, b)})"
    return F.expr(f"case when {a_eq} = {b_eq} then 1D when {size} = 0 then 0D else greatest(0D, least(1D, {dot.format(a, b)} / {size})) end")


_LEAST, _REST = -(1 << 63), 1 << 30


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``next_text`` and ``next_<carried>``: the next row by descending doc_id, the first after the last.

    Ids are cut into ranges of about equal numbers; the first row of each range is also sent to the
    range before, so one shuffle by range is enough and no task holds all rows.  An id that fills
    several ranges (such as null, which counts as the least) is cut by the texts' hashes, by which
    equal ids are ordered.  What the driver gathers, and the tables that are broadcast, have a row a range.
    """
    spark = docs.sparkSession
    key, low, bucket, sub, tie, weight, to, guest = fresh(docs.columns, "#id", "#low", "#bucket", "#sub", "#tie", "#weight", "#to", "#guest")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    n = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx(ident, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    splits = [float("-inf"), *sorted({float(x) for x in cuts}), float("inf")]
    crowded = [(x, m) for x, m in Counter(cuts).items() if m > 1 and (x == _LEAST or abs(x) < 1 << 53)]
    rows = docs.withColumn(key, ident).withColumn(low, F.col(key).cast("double"))
    rows = Bucketizer(splits=splits, inputCol=low, outputCol=bucket).transform(rows) if len(splits) > 2 else rows.withColumn(bucket, F.lit(0.0))
    hashed = F.xxhash64("text")
    if crowded:
        table = F.broadcast(spark.createDataFrame(crowded, f"`{to}` long, `{weight}` long"))
        place = F.floor((hashed.cast("double") / float(1 << 64) + 0.5) * F.col(weight))
        rows = rows.join(table, F.col(key) == F.col(to), "left").withColumn(sub, F.when(F.col(weight).isNull(), F.lit(_REST)).otherwise(F.col(weight) - 1 - place).cast("long")).drop(to, weight)
    else:
        rows = rows.withColumn(sub, F.lit(_REST).cast("long"))
    rows = rows.drop(low)
    # the first row of each range: by its id, among equal ids of a crowded one by hash
    tops = rows.groupBy(bucket, sub).agg(F.max(key).alias("id"), *([F.min(F.when(F.col(sub) < _REST, hashed)).alias("tie")] if crowded else [F.lit(None).cast("long").alias("tie")])).collect()
    tops.sort(key=lambda r: (r[0], r[1]))
    guests = [(r.id, r.tie, *tops[(i + 1) % len(tops)][:2]) for i, r in enumerate(tops)]
    at, own = F.struct(F.col(bucket).alias("b"), F.col(sub).alias("s"), F.lit(False).alias("guest")), fresh([], "#gid", "#gtie", "#gb", "#gs")
    if guests:
        table = F.broadcast(spark.createDataFrame(guests, ", ".join(f"`{c}` {t}" for c, t in zip(own, ("long", "long", "double", "long"), strict=True))))
        gid, gtie, gb, gs = (table[c] for c in own)
        rows = rows.join(table, (rows[key] == gid) & (gtie.isNull() | (hashed == gtie)), "left")
        both = F.when(gid.isNotNull(), F.array(at, F.struct(gb.alias("b"), gs.alias("s"), F.lit(True).alias("guest")))).otherwise(F.array(at))
        rows = rows.withColumn(to, F.explode(both)).drop(*own)
    else:
        rows = rows.withColumn(to, at)
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], key, F.col(f"`{to}`.b").alias(bucket), F.col(f"`{to}`.s").alias(sub), F.col(f"`{to}`.guest").alias(guest), hashed.alias(tie))
    w = Window.partitionBy(bucket, sub).orderBy(guest, F.col(key).desc(), tie)
    wanted = ("text", *carried)
    led = rows.select("*", *[F.lead(c).over(w).alias(name) for c, name in zip(wanted, fresh(docs.columns, *[f"next_{c}" for c in wanted]), strict=True)])
    return led.filter(~F.col(guest)).drop(key, bucket, sub, guest, tie)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likeness to these and to the next texts."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    eq, sim = fingerprint("text")
    first = with_next(text.withColumn("fp", F.struct(eq.alias("eq"), sim.alias("sim"))), "fp")
    n = F.col("n_chars")
    cut = first.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    eq, sim = fingerprint("edited")
    both = cut.select("doc_id", n, F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fp", "next_fp", F.struct(eq.alias("eq"), sim.alias("sim")).alias("ep"))
    signed = both.select("*", signs("fp.sim").alias("a"), signs("ep.sim").alias("b"), signs("next_fp.sim").alias("c"))
    return signed.select("doc_id", "n_chars", "edited_sha256", as_string("fp.eq", "fp.sim").alias("fingerprint"), as_string("ep.eq", "ep.sim").alias("edited_fingerprint"), likeness("a", "b", "fp.eq", "ep.eq").alias("near_edited"), likeness("a", "c", "fp.eq", "next_fp.eq").alias("near_next"))
