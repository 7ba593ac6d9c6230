"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from speechprep.llm import queries, repair

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        t = text.rstrip(SPACE)
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "" if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def search(rows, fault):
    """Dijkstra by (cost, audit) over rows and states."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        role, after = NEXT[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, after))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault[i] not in ("blank", "duplicate"):
                more = fault[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, after))
                first = rows[i][2][:1]
                if first == role[0] or (first == "s" and state == 0):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1 if first == "s" else after))


def apply(rows, audit):
    out, state, rest = [], 0, list(rows)
    for edit in audit:
        _, _, role, text = (None, None, "", "") if edit == "I" else rest.pop(0)
        if edit in "IR":
            role, state = NEXT[state]
        elif edit == "K":
            state = 1 if role[:1] == "s" else NEXT[state][1]
        if edit != "D":
            out.append((role, text))
    assert not rest and (state == 3 or not out)
    return out


def brute(rows, hurt=True):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv]) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        fault = faults(mine)
        cost, audit = search(mine, fault)
        turns = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in apply(mine, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def told(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        turn = rng.choice([0, 1, -3])
        for _ in range(rng.choice([1, 2, 5, longest])):
            rows.append((conv if conv else None, rng.choice([turn] * 6 + [None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice(["Hi.", "Yes!", "well", " ", "", None, "no? \n", "a.b", "ça va ?", "x" * 3000, f"n {rng.random()}."])))
            turn += rng.choice([0, 1, 1, 1, 1, 4])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, kind int, block string, dropped int, digest int"


def test_equals_a_search_over_all_edits(spark):
    rows = made(7, 300, 9)
    df = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], SCHEMA).repartition(5)
    assert told(repair.summary(repair.damaged(df))) == brute(rows)


def test_long_conversations_run_through_blocks(spark):
    rows = made(8, 6, 1500)
    rows += [(100, k, "user", "same.") for k in range(700)] + [(101, None, "assistant", f"{k}.") for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute(rows)
    assert any(len(x[6]) > 600 for x in want.values())
    assert told(repair.summary(repair.damaged(df))) == want


def test_repaired_rows(spark):
    rows = made(9, 60, 8)
    df = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = brute(rows)
    got = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(r)
    for conv, x in want.items():
        mine = got.get(conv, [])
        assert [r.place for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == x[7]
        assert "".join(r.edit for r in mine) == x[6].replace("D", "")


@pytest.mark.parametrize("symbols", ["", "x", "s", "u", "a", "ss", "sua", "uau", "aSOxu", "uuaaUAsoxSa" * 4])
def test_any_grammar_gives_the_same(symbols):
    grammars = ([], ["ua"], ["uu", "aa", "xa", "ĀĀ", "sā"], ["ua", "ĀĀ", "āĀ"])
    got = [repair.cheapest([symbols], repair.matrices(g), g) for g in grammars]
    assert all(x == got[0] for x in got)
    pieces = [symbols[k : k + 3] for k in range(0, len(symbols), 3)]
    cost, parts = repair.cheapest(pieces, repair.matrices(grammars[2]), grammars[2])
    assert (cost, "".join(parts)) == (got[0][0], "".join(got[0][1]))


def test_a_grammar_of_repeated_pairs(spark):
    found = spark.createDataFrame([("suauauaua",), ("uauaua",), ("uaua",), ("",)], "symbols string")
    rules = repair.grammar(found)
    assert len(repair.compressed("uauauauaua", rules)) <= 4 and len(rules) <= repair.ROUNDS * repair.RULES
    table = repair.matrices(rules)
    assert repair.cheapest(["uauauauaua"], table, rules) == (0, ["K" * 10])


def test_all_rows_dropped_and_empty_tables(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert told(repair.summary(repair.damaged(df))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.summary(repair.damaged(df.limit(0))).count() == 0


def test_query_over_the_small_tables(spark, sf):
    for d in (sf, sf.replace("sf0.001", "sf0.01")):
        rows = [tuple(r) for r in queries.read(spark, d, "conversations").select("conv_id", "turn", "role", "text").collect()]
        assert told(queries.op13_conversation_repair(spark, d)) == brute(rows)
