"""URL filters: a trie over reversed host labels, then path segments, with the longest rule first.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's path,
which begins and ends with ``/``.  The longest fitting rule (host and path together, then the
longer host) decides; without one the verdict is ``DEFAULT``.  The trie is broadcast; more than
``MOST_RULES`` rules are refused, so its size is bounded.

Edge cases: a null url or one without ``://`` has an empty host and path and the default verdict;
a port stays part of the host; of two equal rules the later one holds; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT, MOST_RULES = "allow", 1_000_000
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_LOWER = {c: c + 32 for c in range(65, 91)}


class Trie:
    """Nested dicts: host labels from the right, then under "/" the path's segments; under "=" a rule."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"over {MOST_RULES} rules")
        self.root: dict = {}
        for verdict, host, path in rules:
            if not path.startswith("/") or not path.endswith("/"):
                raise ValueError(f"a rule's path begins and ends with /: {path}")
            at = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                at = at.setdefault(label, {})
            at = at.setdefault("/", {})
            for segment in path.split("/")[1:-1]:
                at = at.setdefault(("s", segment), {})
            at["="] = (host.translate(_LOWER) + path, verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str]:
        if not host or not path.startswith("/"):
            return None, DEFAULT
        segments, best, at = path.split("/")[1:-1], None, self.root
        for label in reversed(host.split(".")):
            at = at.get(label)
            if at is None:
                break
            p = at.get("/")
            if p is not None:
                found = p.get("=")
                for s in segments:
                    p = p.get(("s", s))
                    if p is None:
                        break
                    found = p.get("=", found)
                if found and (best is None or len(found[0]) >= len(best[0])):
                    best = found
        return best or (None, DEFAULT)


def parts(url: str | None) -> tuple[str, str]:
    """Host, lower-cased from A to Z, and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages(page_id, url)`` -> page_id, host, path, rule, verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [parts(u) for u in batch.column("url").to_pylist()]
            found = [trie.value.match(h, p) for h, p in cut]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, pa.string()) for x in ([h for h, _ in cut], [p for _, p in cut], [r for r, _ in found], [v for _, v in found]))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
