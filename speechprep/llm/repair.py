"""Conversation structure repair: grammar-compressed dynamic programming over role and fault symbols.

Each row becomes a symbol: its role's initial, or another letter for other roles; upper case if its text
is cut off; ``x`` if it has to go.  Symbols of a conversation, in blocks of ``BLOCK`` rows, are compressed
by Re-Pair: in each of ``ROUNDS`` rounds Spark counts the pairs of neighbours over all distinct blocks, and
the most frequent become rules.  At most ``ROUNDS * RULES`` rules exist, so they fit into each task.

A rule has one min-plus transfer matrix between the four states of ``(s?(ua)+)?``: the least cost of
editing its rows on the way from one state to another, and the audit as a rope.  A rule's matrix is
the product of its two parts', worked out bottom-up once a task and shared by all conversations.
Each edit of a row stands after the insertions before it, so of two audits of the same rows none is
a prefix of the other, and the least of joined audits is joined from least ones.  A conversation is a
vector times its symbols' matrices, with back pointers; states are compared by the order of their
audits so far, so these aren't written out before the end.

What is shuffled for that has a digest in place of the text.  The texts then meet the audits of their blocks
in one sorted stream by conversation, which holds a row and a block's audit at a time; so a
conversation of any length is repaired in constant memory there, and its symbols with a few bytes a
row before.  A digest over a whole conversation needs its rows in one task.

Edge cases: null role, text and parts of the damage key count as one space, a null conv_id is a
conversation; rows of one turn go by a digest of role and text; repeated rows are duplicates; an
empty role or another one can't be kept; a conversation without rows after the damage has zeros and an empty audit; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechprep.llm.store import cut

BLOCK, ROUNDS, RULES, FAULTS = 256, 8, 32, 20
_SPACE, _STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of the edits, by initial; an undeleted row whose text is cut off adds CUT_OFF.
KEEP, INSERT, REROLE, DELETE, CUT_OFF = 0, 2, 2, 3, 1
_START, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
_NEXT = {_START: ("user", _AFTER_U), _AFTER_S: ("user", _AFTER_U), _AFTER_U: ("assistant", _AFTER_A), _AFTER_A: ("user", _AFTER_U)}
#: Cheapest way from each state to an end: cost and audit.
_END = {_START: (0, ""), _AFTER_A: (0, ""), _AFTER_U: (INSERT, "I"), _AFTER_S: (2 * INSERT, "II")}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by a checksum of conv_id and turn; dropped ones are marked."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "utf-8")) % FAULTS
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", _STOPS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.col("kind") == 0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("dropped"))


def _digested(rows: DataFrame) -> DataFrame:
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.encode(whole, "utf-8"), 256)))


_COUNTED = ("blank", "duplicate", "truncated", "illegal", "turns")


def blocks(rows: DataFrame) -> DataFrame:
    """Symbols of each block of rows of a conversation, where it begins, and what it adds to the counts; block -1 has the dropped rows."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    narrow = _digested(rows).select("conv_id", "turn", "dropped", "digest", F.substring("role", 1, 1).alias("initial"), (last == "").alias("empty"), (~last.isin(*_STOPS)).alias("open"))
    order = ["dropped", F.asc_nulls_first("turn"), "digest"]
    w = Window.partitionBy("conv_id").orderBy(*order)
    placed = narrow.repartition("conv_id").select(
        "*",
        (F.row_number().over(w) - 1).alias("place"),
        F.lag("initial").over(w).alias("before"),
        F.lag("turn").over(w).alias("turn_before"),
        (F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(*order)) > 1).alias("seen"),
    )
    fault = F.when(F.col("empty"), "blank").when(F.col("seen"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))
    kept = ~F.col("dropped")
    told = placed.withColumn("fault", fault).select(
        "conv_id",
        F.when(F.col("dropped"), -1).otherwise(F.floor(F.col("place") / BLOCK)).cast("long").alias("block"),
        "place",
        F.when(kept, F.col("turn")).alias("turn"),
        F.when(kept, F.col("digest")).alias("digest"),
        F.when(kept, symbol).otherwise("").alias("symbol"),
        *[(kept & (F.col("fault") == c)).cast("long").alias(c) for c in _COUNTED[:3]],
        (kept & F.col("before").isNotNull() & ~legal).cast("long").alias("illegal"),
        (kept & new_turn).cast("long").alias("turns"),
    )
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "")
    return told.groupBy("conv_id", "block").agg(F.min_by("turn", "place").alias("turn"), F.min_by("digest", "place").alias("digest"), symbols.alias("symbols"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[F.sum(c).alias(c) for c in _COUNTED])


# the grammar


def compressed(symbols: str, rules: list[str]) -> str:
    """``symbols`` with each rule's pair replaced by its own character, in the order of the rules."""
    for k, pair in enumerate(rules):
        symbols = symbols.replace(pair, chr(256 + k))
    return symbols


def grammar(found: DataFrame, rounds: int = ROUNDS, most: int = RULES) -> list[str]:
    """Re-Pair rules of all ``found.symbols``: the pair behind each of the characters from U+0100 on."""
    distinct = cut(found.filter("symbols <> ''").groupBy("symbols").agg(F.count("*").alias("n")), "symbols")
    rules: list[str] = []
    for _ in range(rounds):

        def pairs(batches: Iterator[pa.RecordBatch], rules: list[str] = rules) -> Iterator[pa.RecordBatch]:
            total: Counter[str] = Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    short = compressed(symbols, rules)
                    for pair in zip(short, short[1:], strict=False):
                        if pair[0] != pair[1]:
                            total["".join(pair)] += n
                    for x in set(short):
                        total[x + x] += n * short.count(x + x)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])

        top = distinct.mapInArrow(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(most).collect()
        if not top:
            break
        rules = [*rules, *[r.pair for r in top]]
    return rules


# transfer matrices: for each pair of states None or (cost, rope); a rope is a string or two ropes

def text_of(rope) -> str:
    out, left = [], [rope]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left += (x[1], x[0])
    return "".join(out)


def _least(a, b):
    """The cheaper of two cells, among equals the one whose audit comes first."""
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if text_of(a[1]) <= text_of(b[1]) else b


def of_symbol(symbol: str):
    """Insertions, then the row's own edit."""
    out = [[None] * 4 for _ in range(4)]
    for start in range(4):
        now = start
        for inserted in range(3):  # more lead to no other state
            ways = [(now, DELETE, "D")]
            if symbol != "x":
                more = CUT_OFF if symbol.isupper() else 0
                role, after = _NEXT[now]
                ways.append((after, REROLE + more, "R"))
                if symbol.lower() == role[0]:
                    ways.append((after, KEEP + more, "K"))
                if symbol.lower() == "s" and now == _START:
                    ways.append((_AFTER_S, KEEP + more, "K"))
            for to, cost, edit in ways:
                out[start][to] = _least(out[start][to], (cost + inserted * INSERT, "I" * inserted + edit))
            now = _NEXT[now][1]
    return out


def times(a, b):
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            for k in range(4):
                if a[i][j] and b[j][k]:
                    out[i][k] = _least(out[i][k], (a[i][j][0] + b[j][k][0], (a[i][j][1], b[j][k][1])))
    return out


def matrices(rules: list[str]) -> dict:
    """The matrix of each symbol and, bottom-up, of each rule, with audits written out once."""
    out = {x: of_symbol(x) for x in "suaoSUAOx"}
    for k, (a, b) in enumerate(rules):
        out[chr(256 + k)] = times(out[a], out[b])
    return {x: [[c and (c[0], text_of(c[1])) for c in row] for row in m] for x, m in out.items()}


def remembered(parts: list[str], table: dict, rules: list[str], known: dict, most: int = 50_000) -> tuple[int, list[str]]:
    """``cheapest``, whose results for short conversations are kept, as many have the same symbols."""
    if len(parts) != 1 or len(parts[0]) > 32:
        return cheapest(parts, table, rules)
    if parts[0] not in known:
        if len(known) >= most:
            known.clear()
        known[parts[0]] = cheapest(parts, table, rules)
    return known[parts[0]]


def cheapest(parts: list[str], found: dict, rules: list[str]) -> tuple[int, list[str]]:
    """The least cost of all ``parts`` (blocks of symbols) together, and each one's share of the audit."""
    state, steps = {_START: (0, 0)}, []  # by state: cost, and place in the order of the audits so far
    for n, part in enumerate(parts):
        for x in compressed(part, rules):
            best = {}
            for j, (cost, rank) in state.items():
                for k, cell in enumerate(found[x][j]):
                    if cell:
                        way = (cost + cell[0], rank, cell[1], j)
                        if k not in best or way < best[k]:
                            best[k] = way
            order = {k: r for r, k in enumerate(sorted(best, key=lambda k: best[k][1:3]))}
            state = {k: (way[0], order[k]) for k, way in best.items()}
            steps.append((n, {k: (way[3], way[2]) for k, way in best.items()}))
    cost, _, last = min((state[k][0] + _END[k][0], (state[k][1], _END[k][1]), k) for k in state)
    audits: list[list[str]] = [[] for _ in parts]
    now = last
    for n, back in reversed(steps):
        now, audit = back[now]
        audits[n].append(audit)
    out = ["".join(reversed(x)) for x in audits]
    if out:
        out[-1] += _END[last][1]
    return cost, out


# audits of blocks, and the walk over the texts

_AUDIT = "block long, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(found: DataFrame, rules: list[str]) -> DataFrame:
    """``blocks`` -> (conv_id, turn, digest, block, audit, counts): each block's edits; the counts are those of the whole conversation, in its first block."""
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = matrices(rules), {}
        rows: list[dict] = []

        def out() -> pa.RecordBatch:
            real = [r for r in rows if r["block"] >= 0]
            cost, parts = remembered([r["symbols"] for r in real], table, rules, known)
            total = {c: sum(r[c] for r in rows) for c in _COUNTED}
            low, high = [r["low"] for r in real if r["low"] is not None], [r["high"] for r in real if r["high"] is not None]
            gaps = max(high) - min(low) + 1 - total["turns"] if low else 0
            stats = [gaps, *[total[c] for c in _COUNTED[:4]], cost]
            kept = real or rows[:1]
            share = [*zip(kept, parts or [""], strict=True)]
            lines = [{"conv_id": r["conv_id"], "turn": r["turn"], "digest": r["digest"], "block": r["block"], "audit": audit, **{c: (x if k == 0 else None) for c, x in zip(_STATS, stats, strict=True)}} for k, (r, audit) in enumerate(share)]
            return pa.RecordBatch.from_pylist(lines, schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([*[batch.schema.field(c) for c in ("conv_id", "turn", "digest", "block")], pa.field("audit", pa.string()), *[pa.field(c, pa.int64()) for c in _STATS]])
            for row in batch.to_pylist():
                if rows and rows[0]["conv_id"] != row["conv_id"]:
                    yield out()
                    rows = []
                rows.append(row)
        if rows:
            yield out()

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, digest binary, {_AUDIT}")


class _Walk:
    """A conversation's rows in order under its audit."""

    def __init__(self, first: dict):
        self.conv_id, self.stats, self.state, self.place = first["conv_id"], None, _START, 0
        self.waiting: deque[str] = deque()
        self.now, self.at, self.audit, self.hash = "", 0, [], hashlib.sha256()

    def told(self, row: dict) -> None:
        self.stats = self.stats or {c: row[c] for c in _STATS}
        self.waiting.append(row["audit"])
        self.audit.append(row["audit"])

    def _put(self, edit: str, role: str, text: str, turn) -> tuple:
        self.hash.update((("\n" if self.place else "") + role + ":" + text).encode())
        self.place += 1
        return (self.conv_id, self.place - 1, role, text, edit, turn)

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.now) and self.now[self.at] == "I":
            role, self.state = _NEXT[self.state]
            self.at += 1
            yield self._put("I", role, "", None)

    def row(self, role: str, text: str, turn) -> Iterator[tuple]:
        if self.at == len(self.now):
            self.now, self.at = self.waiting.popleft(), 0
        yield from self._inserted()
        edit = self.now[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = _NEXT[self.state]
            yield self._put(edit, role, text, turn)
        elif edit == "K":
            self.state = _AFTER_S if role[:1] == "s" else _NEXT[self.state][1]
            yield self._put(edit, role, text, turn)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()


def _stream(rows: DataFrame, rules: list[str], found: DataFrame) -> DataFrame:
    """Audits of blocks and rows, sorted so that each audit comes before its rows."""
    told = audits(found, rules).withColumns({"kind": F.lit(0), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = _digested(rows.filter("not dropped").drop("dropped")).withColumn("kind", F.lit(1))
    return told.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("digest"), "kind", "block").drop("digest")


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Walk, list[tuple], bool]]:
    """(walk, repaired rows, whether the conversation has ended)."""
    walk = None
    for batch in batches:
        for row in batch.to_pylist():
            if walk is None or row["conv_id"] != walk.conv_id:
                if walk:
                    yield walk, list(walk.end()), True
                walk = _Walk(row)
            if row["kind"] == 0:
                walk.told(row)
            else:
                yield walk, list(walk.row(row["role"], row["text"], row["turn"])), False
    if walk:
        yield walk, list(walk.end()), True


def _prepared(rows: DataFrame) -> DataFrame:
    found = cut(blocks(rows), "blocks")
    return _stream(rows, grammar(found), found)


def summary(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, dropped)`` -> a row for each conversation: faults, cost, audit and a digest of its repaired rows."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, kind = [], None

        def noted(stream):
            nonlocal kind
            for batch in stream:
                kind = batch.schema.field("conv_id").type
                yield batch

        def out() -> pa.RecordBatch:
            schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in _STATS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            return pa.RecordBatch.from_pylist(lines, schema=schema)

        for walk, _, ended in _walks(noted(batches)):
            if ended:
                lines.append({"conv_id": walk.conv_id, **walk.stats, "audit": "".join(walk.audit), "repaired_sha256": walk.hash.hexdigest()})
                if len(lines) == 1000:
                    yield out()
                    lines = []
        if lines:
            yield out()

    return _prepared(rows).mapInArrow(run, f"conv_id {kinds['conv_id']}, {', '.join(f'{c} long' for c in _STATS)}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, dropped)`` -> (conv_id, place, role, text, edit, turn): the repaired conversations; turn is null where a row was inserted."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {}

        def noted(stream):
            for batch in stream:
                kind.update(conv_id=batch.schema.field("conv_id").type, turn=batch.schema.field("turn").type)
                yield batch

        held, size = [], 0
        for _, new, _ in _walks(noted(batches)):
            held += new
            size += sum(len(r[3]) for r in new)
            if size > 1 << 20 or len(held) > 5000:
                yield _rows(held, kind)
                held, size = [], 0
        if held:
            yield _rows(held, kind)

    return _prepared(rows).mapInArrow(run, f"conv_id {kinds['conv_id']}, place long, role string, text string, edit string, turn {kinds['turn']}")


def _rows(held: list[tuple], kind: dict) -> pa.RecordBatch:
    types = {"conv_id": kind["conv_id"], "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string(), "turn": kind["turn"]}
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))
