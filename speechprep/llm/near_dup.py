"""Near-duplicate classes by BagMinHash signatures, banding and an exact multiset check.

A document is the multiset of its runs of five lower-cased words.  Steps:

1. one pass hashes every whole text, makes its weighted-Jaccard signature and band keys;
2. texts with equal words fall together on one *node*, so copies are never paired, and all later
   work is on one row a node;
3. in each band bucket, the signatures of all its nodes are compared, those of a bucket above
   ``BUCKET`` nodes in pairs of blocks, each pair of blocks a group of its own; only a spanning
   star of each linked set leaves a group;
4. linked sets are closed to candidate classes, and the texts of each class are compared
   exactly, all against all, by blocked matrix products inside tasks; large classes are cut
   into block pairs by texts and by shingles, so a task holds about two bounded blocks.  Spanning
   stars leave again, and each node's number of links;
5. components of the verified links are the classes, named by their least doc_id.

Misses: at a similarity of 0.8 a pair escapes all 24 bands of 5 with probability below 1e-4, and
the signature test with about 1e-4; both fall fast above.  No bucket's size changes that.

Edge cases: a null text counts as empty; a text without words is a class of its own; repeated
rows share a class; a null doc_id never names a class unless all of the class's ids are null, and
then its class_id is null, too.  An empty table gives no rows.  Other columns are ignored by
``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechprep.llm.arrays import U, chunks, mix, occurrence, prose_words, run_hash, shingles, tables
from speechprep.llm.graph import components
from speechprep.llm.store import cut, fresh

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Share of equal registers (low bytes) at which two nodes become candidates: four deviations below 0.8.
LOOSE = 0.65
#: Nodes of a bucket's block, nodes and shingles of a class's block.
BUCKET, BLOCK, BLOCK_KEYS = 512, 512, 500_000


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def bag_signatures(keys: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """``n_docs x m`` winner ids.  P(equal register) = sum(min weight) / sum(max weight), for whole weights.

    Weight is discretised to unit cells, grouped in dyadic levels (0,1], (1,2], (2,4], (4,8], ...
    Every (key, level) is a Poisson process in time with rate m * level length, each point in a
    random register and cell.  A point counts if its cell lies under the weight, so a heavier
    occurrence sees a superset of a lighter one's points.  A process stops as soon as its time
    passes the document's slowest register.
    """
    best = np.full((n_docs, m), np.inf)
    winner = np.zeros((n_docs, m), dtype=U)
    level, low, length = 0, 0, 1
    while True:
        alive = np.flatnonzero(weights > low)
        if not alive.size:
            return winner
        base = mix(keys[alive], 1000 + level)
        now = np.zeros(alive.size)
        step = 0
        while alive.size:
            block = 1 if alive.size > 4096 or step == 0 else 24
            ids = mix(base[:, None] + np.arange(step, step + block, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
            times = now[:, None] - np.cumsum(np.log(_uniform(ids)), axis=1) / (m * length)
            d = doc[alive]
            limit = best.max(axis=1)[d]
            on = times <= limit[:, None]
            if length > 1:
                cell = low + (mix(ids, 3) % U(length)).astype(np.int64)
                on &= cell < weights[alive][:, None]
            i, j = np.nonzero(on)
            at, t, w = d[i] * m + (mix(ids[i, j], 5) % U(m)).astype(np.int64), times[i, j], ids[i, j]
            np.minimum.at(best.reshape(-1), at, t)
            won = best.reshape(-1)[at] == t
            winner.reshape(-1)[at[won]] = w[won]
            go = times[:, -1] <= best.max(axis=1)[d]
            alive, base, now, step = alive[go], base[go], times[go, -1], step + block
        low, length, level = (1, 1, 1) if level == 0 else (low * 2, length * 2, level + 1)


def _weighted(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, to = shingles(words, at, WORDS)
    doc = np.repeat(np.arange(to.size - 1), np.diff(to))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if k.size else np.zeros(0, np.int64)
    return k[first], np.diff(np.append(first, k.size)), d[first], to


def node_of(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's words in order, not a polynomial: such sums agree on texts like the Thue-Morse word and its complement."""
    return np.array([xxhash.xxh3_64_intdigest(words[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=U).astype(np.int64)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables("near_dup")  # lets those of other operators go
    for batch in batches:
        for part in chunks(batch, "text"):
            words, at = prose_words(part.column("text"))
            keys, weights, doc, to = _weighted(words, at)
            some = np.diff(at) > 0
            node = node_of(words, at)
            ids = bag_signatures(keys, weights, doc, part.num_rows)
            flat = ids.reshape(-1)
            start = np.arange(0, flat.size, ROWS)
            band = mix(run_hash(flat, start, start + ROWS) + np.tile(np.arange(BANDS, dtype=U), part.num_rows)).astype(np.int64)
            low = (ids & U(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(node, mask=~some),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(band)),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                    part.column("key"),
                    pa.array(np.diff(to)),
                ],
                names=["doc_id", "node", "bands", "sig", "key", "keys"],
            )


def labels(linked: np.ndarray) -> np.ndarray:
    """Least member reached from each member of a symmetric boolean matrix."""
    n = len(linked)
    out = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, out[None, :], n).min(axis=1)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def grouped(names: list[str], work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A ``mapInArrow`` function over rows sorted by the columns ``names``: ``work`` gets each whole group's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(group: pa.Table) -> Iterator[pa.RecordBatch]:
            u, v, n = work(group)
            if u.size:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = [t.column(c).to_numpy() for c in names]
            if held and all(held[-1].column(c)[-1].as_py() == k[0] for c, k in zip(names, keys, strict=True)):
                pass
            elif held:
                yield from out(pa.concat_tables(held))
                held = []
            edge = np.zeros(t.num_rows, dtype=bool)
            for k in keys:
                edge[1:] |= k[1:] != k[:-1]
            start = np.concatenate([[0], np.flatnonzero(edge), [t.num_rows]])
            for a, b in zip(start[:-1], start[1:], strict=True):
                held.append(t.slice(a, b - a))
                if b < t.num_rows:
                    yield from out(pa.concat_tables(held) if len(held) > 1 else held[0])
                    held = []
        if held:
            yield from out(pa.concat_tables(held))

    return run


def star(node: np.ndarray, lab: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An edge ``(u, v, 0)`` to each linked set's least member, and ``(u, u, n)`` for a node with ``n`` links."""
    off, some = lab != np.arange(lab.size), links > 0
    return np.concatenate([node[off], node[some]]), np.concatenate([node[lab[off]], node[some]]), np.concatenate([np.zeros(off.sum(), np.int64), links[some]])


def _alike(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node = group.column("node").to_numpy()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint8).reshape(len(node), REGISTERS)
    if len(node) == 2:
        lab = np.array([0, 0 if (sig[0] == sig[1]).sum() >= LOOSE * REGISTERS else 1])
    else:
        same = np.zeros((len(node), len(node)), dtype=np.int16)
        for r in range(REGISTERS):
            same += sig[:, r][:, None] == sig[:, r][None, :]
        lab = labels(same >= LOOSE * REGISTERS)
    return star(node, lab, np.zeros(lab.size, np.int64))


def overlap(keys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of 64-bit keys, by matrix products over the shared keys."""
    doc = np.repeat(np.arange(len(keys)), [k.size for k in keys])
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    on = shared[inverse]
    doc, col = doc[on], column[inverse[on]]
    out = np.zeros((len(keys), len(keys)), dtype=np.float64)
    for low in range(0, int(shared.sum()), 4096):
        m = np.zeros((len(keys), 4096), dtype=np.float32)
        part = (col >= low) & (col < low + 4096)
        m[doc[part], col[part] - low] = 1
        out += m @ m.T
    return out


def _verified(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block with itself counts its own links, two blocks those between them."""
    node, first = np.unique(group.column("node").to_numpy(), return_index=True)
    column = group.column("keys")
    keys = [np.frombuffer(column[int(i)].as_py(), dtype=U) for i in first]
    size = np.array([k.size for k in keys])
    both = overlap(keys)
    near = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    block = group.column("b").to_numpy()[first]
    counted = near & (block[:, None] != block[None, :]) if block.min() != block.max() else near
    return star(node, labels(near), counted.sum(axis=1))


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles as a set of (shingle, occurrence) keys, so that set overlap is multiset overlap."""
    for batch in batches:
        _, one = np.unique(batch.column("node").to_numpy(), return_index=True)  # a repeated row's text once in a batch
        for part in chunks(batch.take(pa.array(np.sort(one))), "text"):
            words, at = prose_words(part.column("text"))
            node = node_of(words, at)
            keys, to = shingles(words, at, WORDS)
            doc = np.repeat(np.arange(to.size - 1), np.diff(to))
            keys = mix(keys + occurrence(keys, doc).astype(U) * U(0xA24BAED4963EE407))
            right = node == part.column("node").to_numpy()
            cells = [keys[a:b].tobytes() for a, b in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "root", "k", "b")), pa.array(cells, pa.binary())], names=["node", "root", "k", "b", "keys"]).filter(pa.array(right))


def in_pairs(rows: DataFrame) -> DataFrame:
    """Rows of block ``b`` of ``k`` once for each block they are compared with: ``pair`` names the two blocks."""
    i, j = F.least("b", "o"), F.greatest("b", "o")
    return rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumn("pair", i * F.col("k") + j).drop("o")


def _with(rows: DataFrame, key: str, each: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``each``, one row a ``key``: joined on ~key, so that both sides are exchanged for the join and a crowded key's rows can be split."""
    side = each.withColumn("#w", F.bitwise_not(key)).drop(key)
    return rows.join(side.hint("merge"), F.bitwise_not(rows[key]) == F.col("`#w`")).drop("#w")


def classes(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, node, root, class_id, n_links)``, one row per row of ``docs``.

    ``node`` stands for the text's words, ``root`` for its class, whatever the ids; both are null without words.
    ``n_links`` counts the other texts, copies once, that are at ``THRESHOLD`` or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    made = cut(docs.mapInArrow(signed, "doc_id long, node long, bands array<long>, sig binary, key long, keys long"), "signatures")
    worded = made.filter("node is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = cut(worded.groupBy("node").agg(least.alias("r"), F.max("keys").alias("keys"), F.any_value(F.struct("sig", "bands")).alias("s")), "nodes")
    rows = nodes.select("node", F.explode("s.bands").alias("h"))
    shared = rows.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("h")
    members = cut(_with(rows, "h", shared), "buckets")
    dealt = _with(members, "h", members.groupBy("h").agg(F.ceil(F.count("*") / BUCKET).alias("k")))
    dealt = dealt.join(nodes.select("node", "s.sig").hint("merge"), "node").select("h", "node", "sig", "k", F.pmod(F.xxhash64("node"), "k").alias("b"))
    loose = in_pairs(dealt).select("h", "pair", "node", "sig").repartition("h", "pair").sortWithinPartitions("h", "pair").mapInArrow(grouped(["h", "pair"], _alike), "u long, v long, n long")
    candidates = cut(components(loose.select("u", "v").distinct()), "candidates")

    # the text of a node is looked up by the id and the text's hash, so null ids meet as well
    listed = candidates.join(nodes.select("node", "r", "keys").hint("merge"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("keys") / BLOCK_KEYS))
    listed = _with(listed, "root", listed.groupBy("root").agg(blocks.alias("k"))).select(F.col("r.doc_id").alias("id"), F.col("r.key").alias("of"), "node", "root", "k", F.pmod(F.xxhash64("node"), "k").alias("b"))
    texts = docs.join(listed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of"))).select("text", "node", "root", "k", "b")
    texts = texts.mapInArrow(sets_of, "node long, root long, k long, b long, keys binary")
    pairs = in_pairs(texts).select("root", "pair", "node", "b", "keys")
    links = cut(pairs.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(grouped(["root", "pair"], _verified), "u long, v long, n long"), "links")
    joined = components(links.select("u", "v"))
    numbers = links.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    placed = nodes.select("node", F.col("r.doc_id").alias("least")).join(joined.hint("merge"), "node", "left").join(numbers.hint("merge"), "node", "left")
    placed = placed.select("node", F.coalesce("root", "node").alias("root"), "least", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = _with(placed, "root", placed.groupBy("root").agg(F.min("least").alias("class_id")))
    out = worded.select("doc_id", "node").join(named.hint("merge"), "node").select("doc_id", "node", "root", "class_id", "n_links")
    alone = made.filter("node is null").select("doc_id", "node", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, node, class_id, n_links)``, one row per row of ``docs``; ``node`` is null without words."""
    return classes(docs).select("doc_id", "node", "class_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, less every row of a class but its first (by id, null last); rows without words all stay."""
    rows = classes(docs).filter("node is not null").groupBy("root", "doc_id", "node").agg(F.count("*").alias("rows"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")).alias("r"))
    return keep_rows(docs, first.select("r.doc_id", "r.node", "r.rows"))


def keep_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of ``docs`` without words, and one row for each ``(doc_id, node, rows)`` of ``first``; only ids listed with several rows are gathered."""
    names = docs.columns
    key, node, of, found, rows = fresh(names, "#key", "#node", "#of", "#found", "#rows")
    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType()), T.StructField(node, T.LongType())])
    tagged = docs.withColumn(key, F.col("doc_id").cast("long")).mapInArrow(_with_node([*names, key, node]), schema)
    listed = first.select(F.col("doc_id").alias(of), F.col("node").alias(found), F.col("rows").alias(rows))
    kept = tagged.join(listed.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(of)) & (F.col(node) == F.col(found)), "left").filter(F.col(node).isNull() | F.col(found).isNotNull())
    several = kept.filter(F.col(rows) > 1).dropDuplicates([of, found])
    out = [F.col(f"`{c}`") for c in names]
    return kept.filter(F.col(rows).isNull() | (F.col(rows) == 1)).select(*out).unionByName(several.select(*out))


def _with_node(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words, at = prose_words(part.column("text"))
                node = pa.array(node_of(words, at), mask=np.diff(at) == 0)
                yield pa.RecordBatch.from_arrays([*part.columns, node], names=names)

    return run
