"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

A token sequence is what BPE makes of a text exactly if no merge crosses the border of any two
neighbours, and each prefix has one such sequence.  So the merges are compiled into a
nondeterministic transducer whose states are (last token, place in the byte trie of the next one);
an arc that ends a token is open only if the pair of tokens holds.  Determinising it lazily, a
state is the set of live (pending tokens, last token, trie place); tokens on which all members
agree are emitted at once, after a lookahead bounded by the longest token.

All tables are bounded by bytes, by a rough count of what Python objects take.  Past ``FST_BYTES``,
even within a piece, the states made after the first half of that go, as the first ones are the
most used.  Whole pieces of up to ``SHORT`` characters are remembered in two generations of
``PIECE_BYTES``; a full one replaces the older.

Edge cases: null and empty texts have no tokens and the hash of no bytes; a text of any length is
processed whole, piece by piece; repeated rows give equal rows; other columns are kept out.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from speechprep.llm.arrays import tables

FST_BYTES, PIECE_BYTES, SHORT, PAIRS = 96 << 20, 24 << 20, 64, 400_000
INF = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What the ranks say about single tokens and pairs of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.spines: dict[tuple[int, bool], tuple[list[tuple[bytes, int]], bool]] = {}

    def merge(self, piece: bytes) -> tuple[list[bytes], dict[bytes, tuple[bytes, bytes]]]:
        """Plain BPE: the least rank first, leftmost among equals; also the halves of each merged part."""
        parts, halves = [piece[i : i + 1] for i in range(len(piece))], {}
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], INF), i) for i in range(len(parts) - 1))
            if rank == INF:
                break
            halves[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, halves

    def spine(self, token: int, right: bool) -> tuple[list[tuple[bytes, int]], bool]:
        """The parts along one edge of a token's derivation, each with the rank at which it is swallowed; whether ranks only rise."""
        if (token, right) not in self.spines:
            b = self.bytes_of[token]
            parts, halves = self.merge(b)
            out, end, plain = [], INF, len(parts) == 1
            while plain:
                out.append((b, end))
                end = self.ranks[b]
                plain = out[-1][1] > end
                if b not in halves:
                    break
                b = halves[b][right]
            self.spines[token, right] = (out, plain)
        return self.spines[token, right]

    def holds(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b as they are when they stand side by side."""
        (left, plain), (right, plain_too) = self.spine(a, True), self.spine(b, False)
        if plain and plain_too:
            for x, x_end in left:
                for y, y_end in right:
                    r = self.ranks.get(x + y)
                    if r is not None:
                        if r <= self.ranks[x] or r <= self.ranks[y]:
                            return self.simulated(a, b)
                        if r < x_end and r <= y_end:
                            return False
            return True
        return self.simulated(a, b)

    def simulated(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b])[0] == [self.bytes_of[a], self.bytes_of[b]]


class Transducer:
    """The lazily determinised encoder; ``encode`` is one walk over a piece's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for b, r in ranks.items():
            at = 0
            for x in b:
                nxt = self.child[at].get(x)
                if nxt is None:
                    nxt = self.child[at][x] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                at = nxt
            self.token[at] = r
        self.pairs: dict[int, bool] = {}
        self.ids: dict[tuple, int] = {}
        self.members: list[tuple] = []
        #: state << 8 | byte -> the next state, or that and the tokens emitted
        self.arcs: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        self.size, self.core, self.core_size = 0, 0, 0
        self.state((((), -1, 0),))

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.members)
            self.members.append(key)
            self.size += 200 + 120 * len(key)
        return found

    def shrink(self) -> None:
        """Back to the states of the core."""
        n = self.core
        self.ids = {k: i for k, i in self.ids.items() if i < n}
        del self.members[n:]
        self.arcs = {k: f for k, f in self.arcs.items() if k >> 8 < n and (f if type(f) is int else f[0]) < n}
        self.size = self.core_size

    def holds(self, a: int, b: int) -> bool:
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
                self.merges.spines.clear()
            found = self.pairs[key] = a < 0 or self.merges.holds(a, b)
        return found

    def arc(self, state: int, byte: int) -> int | tuple[int, tuple[int, ...]]:
        """Members stay in the order of where their last token ends, so equal sets are equal tuples."""
        out, ended, child, token, pairs = [], None, self.child, self.token, self.pairs
        for pending, last, at in self.members[state]:
            nxt = child[at].get(byte)
            if nxt is None:
                continue
            if child[nxt]:
                out.append((pending, last, nxt))
            t = token[nxt]
            if t is not None and ended is None:
                held = pairs.get(last << 24 | t)
                if held or held is None and self.holds(last, t):
                    ended = ((*pending, t), t, 0)
        if ended is not None:
            out.append(ended)
        if not out:
            raise ValueError("the ranks lack a byte")
        emitted = out[0][0]
        if emitted and len(out) > 1:
            for p, _, _ in out:
                while p[: len(emitted)] != emitted:
                    emitted = emitted[:-1]
        if emitted:
            n = len(emitted)
            out = [(p[n:], last, at) for p, last, at in out]
        if self.size > FST_BYTES:
            self.shrink()
            to = self.state(tuple(out))
            return (to, emitted) if emitted else to
        to = self.state(tuple(out))
        found = self.arcs[state << 8 | byte] = (to, emitted) if emitted else to
        self.size += 250 if emitted else 140
        if not self.core and self.size > FST_BYTES // 2:
            self.core, self.core_size = len(self.members), self.size
        return found

    def encode(self, piece: bytes) -> list[int]:
        state, out, known = 0, [], self.arcs.get
        for byte in piece:
            found = known(state << 8 | byte)
            if found is None:
                found, known = self.arc(state, byte), self.arcs.get
            if type(found) is int:
                state = found
            else:
                state, emitted = found
                out += emitted
        for pending, last, at in self.members[state]:
            if at == 0:
                out += pending
                return out
        raise ValueError("no tokens fit the piece")


class Encoder(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces, self.fst, self.size = ranks, regex.compile(pattern), Transducer(ranks), 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            b = piece.encode()
            whole = self.ranks.get(b)
            ids = self.fst.encode(b) if whole is None else [whole]
            ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            self.size += 240 + 2 * len(piece) + len(ids)
            if self.size > PIECE_BYTES:
                self.older, self.size = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))


#: UTF-8 as a state machine: state -> (first byte, last byte, next state) of each range.  0 stands between characters.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0xA0, 0xBF, 1)],
    3: [(0x80, 0xBF, 1)],
    4: [(0x80, 0x9F, 1)],
    5: [(0x90, 0xBF, 3)],
    6: [(0x80, 0xBF, 3)],
    7: [(0x80, 0x8F, 3)],
}
_STEP = {(s, b): t for s, ranges in UTF8.items() for low, high, t in ranges for b in range(low, high + 1)}


class StreamDecoder:
    """Tokens in, text out as soon as its characters are whole; a byte that fits nowhere becomes U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.whole: dict[int, str | None] = {}
        self.state, self.held = 0, b""

    def feed(self, ids) -> str:
        whole, known = self.whole, self.whole.get
        if self.state == 0 and None not in (out := list(map(known, ids))):
            return "".join(out)
        out = []
        for t in ids:
            if self.state == 0:
                text = known(t)
                if text is None and t not in whole:
                    text = whole[t] = self._alone(t)
                if text is not None:
                    out.append(text)
                    continue
            for b in self.bytes_of[t]:
                to = _STEP.get((self.state, b))
                if to is None:
                    out.append("�" * bool(self.held))
                    self.held, to = b"", _STEP.get((0, b))
                    if to is None:
                        out.append("�")
                        self.state = 0
                        continue
                self.held += bytes([b])
                self.state = to
                if to == 0:
                    out.append(self.held.decode())
                    self.held = b""
        return "".join(out)

    def _alone(self, token: int) -> str | None:
        state = 0
        for b in self.bytes_of[token]:
            state = _STEP.get((state, b), -1)
            if state < 0:
                return None
        return None if state else self.bytes_of[token].decode()

    def finish(self) -> str:
        out, self.state, self.held = "�" * bool(self.held), 0, b""
        return out


def ready(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """Compiled once in each Python worker, which keeps it until it serves another operator."""
    mine = tables("bpe")
    if (path, pattern) not in mine:
        ranks = read_ranks(path)
        mine[path, pattern] = (Encoder(ranks, pattern), StreamDecoder(ranks))
    return mine[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``: ids encoded, then decoded by stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = ready(path, pattern)
        gc.disable()  # the tables hold no cycles, and walking them again and again costs more than the encoding
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n, ids_hash, text_hash, kept = [], [], [], []
                for text in part.column("text"):
                    ids = encoder.encode(text.as_py() or "")
                    values = np.frombuffer(ids, dtype="<u4")
                    digest = hashlib.sha256()
                    for at in range(0, values.size, 65536):
                        digest.update(decoder.feed(values[at : at + 65536].tolist()).encode())
                    digest.update(decoder.finish().encode())
                    n.append(values.size)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(digest.hexdigest())
                    kept.append(values.view("<i4"))
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        gc.enable()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
