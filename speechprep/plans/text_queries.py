"""Queries over text functions, each with a DuckDB oracle.

``documents`` hold few of the patterns, so inputs are decorated by one SQL text that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.functions import text as X
from speechprep.functions import values as V
from speechprep.operators import jobs
from speechprep.plans import text_sql as S
from speechprep.plans.text_sql import quoted, replaced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ID, _NL = "CAST(doc_id % 97 AS STRING)", "chr(10)"


def documents(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """``doc_id, t``: decorated texts, dealt over the session's partitions as the files may be few."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).select("doc_id", F.expr(source).alias("t"))


def text_query(name: str, source: str, out: dict[str, tuple[Callable[[Column], Column], str]]) -> None:
    """Register ``name``: columns from functions of ``t``, and their SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir, source).select("doc_id", *[f(F.col("t")).alias(c) for c, (f, _) in out.items()])

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {', '.join(f'{sql} AS {c}' for c, (_, sql) in out.items())} FROM (SELECT doc_id, {source} AS t FROM documents)"


def expect(name: str, source: str, f: Callable[[Column], Column], want: str) -> None:
    """``want`` spells out what becomes of the decorations around each text."""
    text_query(name, source, {"out": (f, want)})


_MAIL = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")
_PERCENT = (r"([0-9]+(?:\.[0-9]+)?)%", r"\1 percent")
_MONTH = "['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September'][1 + doc_id % 9]"
expect("x1_drop_blocks", f"text || ' <pre><code>int x = ' || {_ID} || ';</code></pre> then <SCRIPT src=a>b</SCRIPT> end'", X.drop_blocks, "left(t, instr(t, ' <pre>')) || '</pre> then  end'")
_NESTED = "repeat('<di', 12) || '<div class=\"kg-card\">a</div>' || repeat('v class=\"kg-card\">b</div>', 12)"
expect("x2_drop_cards", f"text || ' <div class=\"kg-card big\">card ' || {_ID} || '</div> mid ' || {_NESTED} || ' end'", X.drop_cards, "left(t, instr(t, ' <div')) || ' mid  end'")
expect("x3_drop_code", f"text || ' ```py' || {_NL} || 'x = 1```' || ' and `f' || {_ID} || '()` end'", X.drop_code, "left(t, instr(t, ' ```py')) || ' and  end'")
expect("x4_drop_tables", f"text || {_NL} || '|a|b|' || {_NL} || '|---|:-:|' || {_NL} || '|' || {_ID} || '|2|' || {_NL} || 'End'", X.drop_tables, f"left(t, instr(t, {_NL} || '|a|b|') - 1) || repeat({_NL}, 4) || 'End'")
expect("x5_drop_footnotes", f"text || ' claim[^' || {_ID} || '] and source[2].'", X.drop_footnotes, "left(t, instr(t, ' claim[')) || 'claim and source.'")
expect("x6_drop_calls", f"text || {_NL} || 'Subscribe to letter ' || {_ID} || {_NL} || '  read more here' || {_NL} || 'We subscribe.'", X.drop_calls, f"left(t, instr(t, {_NL} || 'Subscribe to letter') - 1) || repeat({_NL}, 3) || 'We subscribe.'")
expect("x7_drop_symbol_lines", f"text || {_NL} || '💎 Plan ' || {_ID} || {_NL} || '• item' || {_NL} || 'Rest'", X.drop_symbol_lines, f"left(t, instr(t, {_NL} || '💎') - 1) || repeat({_NL}, 3) || 'Rest'")
_MIXED = f"'<figure>x</figure>' || text || ' <div class=\"kg-card\">c</div> `code` note[1]' || {_NL} || {_NL} || {_NL} || {_NL} || 'Follow us on ' || {_ID} || {_NL} || '• item' || {_NL} || 'End  '"
expect("x8_filter_silent", _MIXED, X.filter_silent, f"substr(left(t, instr(t, ' <div class')), 19) || '  note' || {_NL} || {_NL} || 'End'")
expect(
    "x9_section_map",
    f"CASE WHEN doc_id % 3 = 0 THEN '<h2>Part ' || {_ID} || '</h2>' || text || '<h3 id=a><b>Two</b></h3>' WHEN doc_id % 3 = 1 THEN text || {_NL} || '## Part ' || {_ID} || {_NL} || '### More' ELSE text END",
    X.section_map,
    f"CASE doc_id % 3 WHEN 0 THEN 'Sections: Part ' || {_ID} || ' | Two' WHEN 1 THEN 'Sections: Part ' || {_ID} || ' | More' ELSE '' END",
)
_EMPHASIS = [(r"\*\*(.*?)\*\*|__(.*?)__|\*(.*?)\*|_(.*?)_", r"\1\2\3\4")]
_MARKED = f"'---' || {_NL} || 'a: b' || {_NL} || '---' || {_NL} || '# Head ' || {_ID} || {_NL} || '> quote **bold** and *thin* ![i](p.png) [link](u/v)' || {_NL} || '***' || {_NL} || text"
expect("x10_strip_markdown", _MARKED, X.strip_markdown, f"'Head ' || {_ID} || {_NL} || 'quote bold and thin  link' || {_NL} || {_NL} || {replaced("substr(t, instr(t, '***') + 4)", *_EMPHASIS)}")
expect("x11_strip_addresses", f"text || ' see https://a.example/p?q=' || {_ID} || ' or www.b.example and me' || {_ID} || '@mail.example.org now'", X.strip_addresses, f"{replaced("left(t, instr(t, ' see https'))", _MAIL)} || 'see  or  and  now'")
expect("x12_strip_tags", f"'<p>a</p><p class=x>b <em>' || {_ID} || '</em></p>' || text", X.strip_tags, f"' a  b ' || {_ID} || ' ' || substr(t, instr(t, '</em></p>') + 9)")
expect("x13_unescape", f"text || ' a &amp; b &lt; ' || {_ID} || ' &gt; c &quot;d&quot; e&nbsp;f &amp;lt; &#233;&#x1F600; &Eacute; &eacute &notit; &rarr;'", X.unescape, f"left(t, instr(t, ' a &amp;')) || 'a & b < ' || {_ID} || ' > c \"d\" e' || chr(160) || 'f &lt; é😀 É é ¬it; →'")
_MONEY = f"text || ' Revenue hit $' || {_ID} || '.5B, then $3m and $1,200.50 of $7.'"
_HIT = f"left(t, instr(t, ' Revenue hit')) || 'Revenue hit ' || {_ID} || '.5 billion dollars, then 3 million dollars and "
expect("x14_spoken_magnitudes", _MONEY, X.spoken_magnitudes, f"{_HIT}$1,200.50 of $7.'")
expect("x15_spoken_dollars", _MONEY, X.spoken_amounts, f"{_HIT}1,200.50 dollars of 7 dollars.'")
expect("x16_per_unit", f"text || ' costs ' || {_ID} || '/Month or 5/user and a/b'", X.spoken_units, f"left(t, instr(t, ' costs {''}')) || 'costs ' || {_ID} || ' per month or 5 per user and a/b'")
expect("x17_multiples", f"text || ' grew ' || {_ID} || 'x and 2.5X, 12.5% of 24/7 work'", X.spoken_multiples, f"{replaced("left(t, instr(t, ' grew '))", _PERCENT)} || 'grew ' || {_ID} || ' times and 2.5 times, 12.5 percent of twenty-four seven work'")
_ORDINAL = f"coalesce(['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth', 'eleventh', 'twelfth', 'thirteenth', 'fourteenth', 'fifteenth', 'sixteenth', 'seventeenth', 'eighteenth', 'nineteenth', 'twentieth'][doc_id % 97], {_ID})"
expect("x18_ordinals", f"text || ' the ' || {_ID} || 'th and 1st, 02ND, 20th, 101st'", X.spoken_ordinals, f"left(t, length(t) - length(' the ' || {_ID} || 'th and 1st, 02ND, 20th, 101st')) || ' the ' || {_ORDINAL} || ' and first, second, twentieth, 101'")
expect("x19_iso_dates", "text || ' on 2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-15, 2023-11-07 and 0987-14-30.'", X.spoken_dates, f"left(t, length(t) - 42) || ' on ' || {_MONTH} || ' 15, 2024, November 7, 2023 and 14 30, 987.'")
_SHORT = f"text || ' The CEO of a SaaS firm, e.g. B2B ' || {_ID} || ' vs. P&L by VP (KPI), APEX stays. It was the best. Q etc.'"
expect("x20_abbreviations", _SHORT, X.spoken_abbreviations, S.abbreviated("t"))
_RAW = f"'<p>' || text || '</p> Revenue hit $' || {_ID} || '.5B on 2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-15, the 3rd time, for the CEO.'"
expect("x21_normalize", _RAW, X.normalize, S.normalized("t"))
_SPOKEN = f"'<think>no</think>Dr. Who and Prof. X' || {_ID} || ' said “it’s → 5°” [PAUSE] yes [LONG_PAUSE] ' || text || ' #end () wait... now'"
expect("x22_clean_for_speech", _SPOKEN, X.clean_for_speech, S.cleaned("t"))
expect("x23_strip_artifacts", f"'<think>hm ' || {_ID} || '</think>Sure, here it is:' || {_NL} || {_NL} || text || {_NL} || 'I hope it helps ' || {_ID}", X.strip_artifacts, S.stripped("t"))
_PAUSED = f"'A. [PAUSE] ' || replace(text, {_NL}, ' [pause] ') || ' [LONG_PAUSE] C ' || {_ID} || '.'"
_PARTS_SQL = "list_filter(list_transform(string_split(regexp_replace(t, '(?i)\\[(?:LONG_PAUSE|PAUSE)\\]', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
text_query("x24_split_pauses", _PAUSED, {"parts": (lambda t: F.array_join(X.split_pauses(t)["text"], "|"), f"array_to_string({_PARTS_SQL}, '|')"), "last_ms": (lambda t: F.element_at(X.split_pauses(t)["pause_ms"], -1), "CAST(0 AS INTEGER)"), "n": (lambda t: F.size(X.split_pauses(t)), f"CAST(len({_PARTS_SQL}) AS INTEGER)")})
_SENTENCES_SQL = "string_split(regexp_replace(t, '([.!?])\\s+([A-Z\"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
text_query("x26_split_sentences", "text", {"n": (lambda t: F.size(X.split_sentences(t)), f"CAST(len({_SENTENCES_SQL}) AS INTEGER)"), "first_sentence": (lambda t: F.element_at(X.split_sentences(t), 1), f"{_SENTENCES_SQL}[1]")})
text_query("x29_split_quotes", f"'He said “yes ' || {_ID} || '” and \"no\" to ' || text", {"n": (lambda t: F.size(F.filter(X.split_quotes(t), lambda x: x["is_quote"])), "CAST(len(regexp_extract_all(t, '[\"“”](.+?)[\"”]', 1)) AS INTEGER)"), "quoted": (X.has_quote, "regexp_matches(t, '[\"“”](.+?)[\"”]')")})
expect("x31_sanitize", f"'(see ' || {_ID} || ') NASA had 1,200.5 units of X9 ' || lower(text)", X.sanitize, f"'had some units of X9 ' || {replaced("substr(t, instr(t, 'of X9 ') + 6)", (r"\([^)]{0,200}\)", ""), (r"\b[0-9][0-9,.]*\b", "some"), (r"\s{2,}", " "), (r"\s+$", ""))}")
_TAILED = "list_filter(list_transform(string_split(regexp_replace(replace(t, chr(10), ' '), '([.?!]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
text_query("t4_tail_sentences", "text", {"out": (X.tail_sentences, f"array_to_string({_TAILED}[greatest(len({_TAILED}) - 2, 1):], ' ')")})
text_query("x37_word_count", "text", {"n": (X.word_count, "CAST(len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS INTEGER)")})
text_query("x35_is_meta", "CASE doc_id % 5 WHEN 0 THEN 'The story described in it. ' WHEN 1 THEN 'This text explores a thing. ' WHEN 2 THEN 'Now. The story described. ' WHEN 3 THEN 'So the following is a reading, ' ELSE '' END || text", {"meta": (X.is_meta, "doc_id % 5 IN (0, 1, 3)")})
expect("x38_strip_player", f"'<div class=\"audio-player\"><audio src=a' || {_ID} || '></audio></div>' || text || '<audio controls>x</audio>'", X.strip_player, "substr(left(t, instr(t, '<audio controls>') - 1), instr(t, '</div>') + 6)")
text_query("p5_has_audio", "CASE WHEN doc_id % 3 = 0 THEN '<AUDIO src=x>' ELSE '<p>audio</p>' END || text", {"has": (X.has_audio, "regexp_matches(t, '(?i)<audio[^>]*>')")})
text_query("p6_has_player", f"CASE WHEN doc_id % 3 = 0 THEN '<div class=\"audio-player\">' || repeat('x', 60) || '</div>' ELSE '<audio>a</audio>' END || text", {"has": (X.has_player, "doc_id % 3 = 0")})
text_query(
    "p7_speakable",
    "CASE doc_id % 6 WHEN 0 THEN '   ' WHEN 1 THEN text || ' ```' WHEN 2 THEN text || ' https://x' WHEN 3 THEN text || ' get_voice_clone' WHEN 4 THEN '12345 67890 ab' ELSE text END",
    {
        "reason": (
            lambda t: X.speakable(t)["reason"],
            "CASE WHEN trim(t) = '' THEN 'empty text' WHEN contains(t, '```') THEN 'code fence' WHEN regexp_matches(t, 'https?://') THEN 'raw URL' WHEN regexp_matches(t, '\\b[a-z][a-z0-9]+(?:_[a-z0-9]+){2,}\\b') THEN 'snake_case identifier' WHEN CAST(length(regexp_replace(t, '[\\pL\\s]', '', 'g')) AS DOUBLE) / greatest(length(t), 1) > 0.40 THEN 'non-alpha ratio' END",
        )
    },
)
text_query("s11_embed_player", f"CASE WHEN doc_id % 2 = 0 THEN '<p>a</p><div class=\"audio-player\">old ' || {_ID} || '</div>' ELSE '' END || text", {"out": (lambda t: X.embed_player(t, F.lit("<div class=\"audio-player\">new</div>")), "CASE WHEN regexp_matches(t, '(?is)<div[^>]*audio-player[^>]*>.*?</div>') THEN regexp_replace(t, '(?is)<div[^>]*audio-player[^>]*>.*?</div>', '<div class=\"audio-player\">new</div>') ELSE '<div class=\"audio-player\">new</div>' || t END")})
_CODED = "translate(CAST(doc_id * 7919 + 12345 AS STRING), '0123456789', 'abcdefghij')"
text_query(
    "x25_word_error_rate",
    f"{_CODED} || '|' || translate(CAST(doc_id * 7919 + 10365 AS STRING), '0123456789', 'abcdefghij')",
    {"wer": (lambda t: F.round(X.wer(F.regexp_replace(F.split_part(t, F.lit("|"), F.lit(1)), "(.)", "$1 "), F.regexp_replace(F.split_part(t, F.lit("|"), F.lit(2)), "(.)", "$1, ")), 6), "round(levenshtein(split_part(t, '|', 1), split_part(t, '|', 2)) / CAST(length(split_part(t, '|', 1)) AS DOUBLE), 6)")},
)
text_query("x32_job_ids", "CASE WHEN doc_id % 3 = 0 THEN 'blog-pid-' || lpad(CAST(doc_id AS STRING), 24, '0') || '-slug-1' WHEN doc_id % 3 = 1 THEN 'backfill-' || lpad(CAST(doc_id AS STRING), 24, 'a') || '-x' ELSE 'blog-pid-12-x' END", {"post": (X.post_of_job, "CASE WHEN regexp_extract(t, '-pid-([^-]*)', 1) <> '' THEN CASE WHEN length(regexp_extract(t, '-pid-([^-]*)', 1)) = 24 THEN regexp_extract(t, '-pid-([^-]*)', 1) END WHEN regexp_extract(t, '(?:^|-)([0-9a-f]{24})(?:-|$)', 1) <> '' THEN regexp_extract(t, '(?:^|-)([0-9a-f]{24})(?:-|$)', 1) END")})
_FACTS = f"text || ' sales grew ' || {_ID} || '% to $2.3 billion in Q3 2024, \"we are on track\" said Jane Smith Doe, then at Acme of Spain, on 3/4/2024 today, last week or Tuesday; about 12 million.'"
#: By kind: what the texts hold themselves, and what the decoration adds.
_ENTITIES = {
    "number": (r"([0-9]+(?:\.[0-9]+)?%|\$[0-9,.]+|\b[0-9]{4}\b)", f"{_ID} || '%|$2.3|2024|2024|12 million'"),
    "date": (r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})\b", "'Q3 2024|3/4/2024|today|last week|Tuesday'"),
    "quote": (r'"([^"]{4,})"', "'we are on track'"),
    "name": (r"[a-z,;:] ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", "'Jane Smith Doe'"),
    "single": (r" (?:by|from|at|for|of|with|via|to|and|or|the)  ([A-Z][a-zA-Z]{3,})[ ,.;:!?]", "'Acme|Spain|Tuesday'"),
}


def x33_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir, _FACTS).select("doc_id", X.entities(F.col("t")).alias("e"))
    return found.select("doc_id", *[F.expr(f"array_join(transform(filter(e, x -> x.kind = '{k}'), x -> x.value), '|')").alias(k) for k in _ENTITIES])


def _own_entities(kind: str) -> str:
    own, pattern = "left(t, instr(t, ' sales grew'))", _ENTITIES[kind][0]
    own = f"replace({own}, ' ', '  ')" if kind == "single" else own
    return f"list_transform(regexp_extract_all({own}, {quoted(pattern)}, 1), lambda x: trim(x))"


def _entities_sql() -> str:
    cells = [f"array_to_string(list_concat({_own_entities(k)}, [{more}]), '|') AS {k}" for k, (_, more) in _ENTITIES.items()]
    return f"SELECT doc_id, {', '.join(cells)} FROM (SELECT doc_id, {_FACTS} AS t FROM documents)"


QUERIES["x33_entities"] = x33_entities
ORACLES["x33_entities"] = _entities_sql()
text_query("n1_token_bound", "text", {"bound": (lambda t: V.token_bound(X.word_count(t)), "CAST(greatest(ceil(round(len(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) * 0.42 * 12 * 1.3, 6)), 300) AS BIGINT)")})
text_query("n2_job_seed", "'job-' || CAST(doc_id AS STRING)", {"seed": (V.job_seed, "CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % 2147483648"), "third_retry": (lambda t: F.element_at(V.retry_seeds(V.job_seed(t)), 3), "(CAST(('0x' || substr(sha256(t), 1, 8)) AS BIGINT) % 2147483648 + 23757) % 2147483648")})
text_query("n9_json_items", f"CASE doc_id % 3 WHEN 0 THEN '```json' || {_NL} || '[\"a\", \"b' || {_ID} || '\"]' || {_NL} || '```' WHEN 1 THEN '[\"c\"]' ELSE 'none' END", {"items": (lambda t: F.array_join(V.json_items(t), "|"), f"CASE doc_id % 3 WHEN 0 THEN 'a|b' || {_ID} WHEN 1 THEN 'c' END")})

# documents cut into paragraphs and packs

_CHUNKS = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, {norm} AS t FROM (SELECT doc_id, source, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents)),
paras AS MATERIALIZED (SELECT doc_id, source, list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps, t FROM d),
units AS (SELECT doc_id, source, CASE WHEN len(ps) <= 1 THEN [t] ELSE ps END AS ps FROM paras),
flat AS MATERIALIZED (SELECT doc_id, source, i, len(list_filter(string_split_regex(ps[i], '\\s+'), lambda x: x <> '')) AS w FROM units, unnest(range(1, len(ps) + 1)) AS r(i)),
packed AS (
  SELECT doc_id, source, i, w, w AS total, 0 AS seg FROM flat WHERE i = 1
  UNION ALL
  SELECT f.doc_id, f.source, f.i, f.w, CASE WHEN p.total + f.w > 400 THEN f.w ELSE p.total + f.w END, CASE WHEN p.total + f.w > 400 THEN p.seg + 1 ELSE p.seg END
  FROM packed p JOIN flat f ON f.doc_id = p.doc_id AND f.i = p.i + 1
),
segs AS (SELECT doc_id, source, CAST(seg AS INTEGER) AS seg_idx, CAST(sum(w) AS INTEGER) AS word_count FROM packed GROUP BY doc_id, source, seg)
"""


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").repartition(spark.sparkContext.defaultParallelism)
    clean = X.normalize(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs.select("doc_id", "source", F.posexplode(X.chunk_paragraphs(clean, 400)).alias("seg_idx", "text")).withColumn("word_count", X.word_count(F.col("text")))


def x28_chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("doc_id", "source", "seg_idx", "word_count")


def a13_segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised documents in segments, summed up by source: the flagship."""
    return jobs.segment_plan(chunked(spark, sf_dir), "source")


_NORM_SQL = S.normalized("t")


def _blanks(sql: str) -> str:
    """``sql`` with the white space of Java's patterns: any between words, that of ASCII elsewhere."""
    return sql.replace("'\\s+'", f"'[{S.WS_U}]+'").replace("\\s", f"[{S.WS}]")


QUERIES |= {"x28_chunk_paragraphs": x28_chunk_paragraphs, "a13_segment_plan": a13_segment_plan}
ORACLES["x28_chunk_paragraphs"] = _blanks(_CHUNKS).replace("{norm}", _NORM_SQL) + "SELECT doc_id, source, seg_idx, word_count FROM segs"
ORACLES["a13_segment_plan"] = _blanks(_CHUNKS).replace("{norm}", _NORM_SQL) + "SELECT source, count(*) AS segments, CAST(sum(word_count) AS BIGINT) AS words, max(word_count) AS longest FROM segs GROUP BY source"


def x27_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, f"replace(text, {_NL}, {_NL} || {_NL})")
    return docs.select("doc_id", F.posexplode(X.segment(F.col("t"), 400)).alias("seg_idx", "text")).select("doc_id", "seg_idx", X.word_count(F.col("text")).alias("word_count"))


QUERIES["x27_segment"] = x27_segment
#: Greedy packing twice: sentences of long paragraphs, then all units; a last segment under 40 words joins the one before.
ORACLES["x27_segment"] = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
paras AS MATERIALIZED (SELECT doc_id, p, unnest(list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS para, generate_subscripts(list_filter(list_transform(string_split_regex(t, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1) AS p0 FROM (SELECT doc_id, t, 0 AS p FROM d)),
counted AS MATERIALIZED (SELECT doc_id, p0 AS p, para, list_filter(string_split_regex(para, '\\s+'), lambda x: x <> '') AS ws, string_split(regexp_replace(para, '([.!?])\\s+([A-Z"“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM paras),
long AS MATERIALIZED (SELECT doc_id, p, len(ws) AS n, ss FROM counted WHERE len(ws) > 440),
sentences AS MATERIALIZED (SELECT doc_id, p, i, len(list_filter(string_split_regex(ss[i], '\\s+'), lambda x: x <> '')) AS w FROM long, unnest(range(1, len(ss) + 1)) AS r(i) WHERE len(ss) > 1),
inner_packs AS (
  SELECT doc_id, p, i, w, w AS total, 0 AS k FROM sentences WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.p, s.i, s.w, CASE WHEN q.total + s.w > 400 THEN s.w ELSE q.total + s.w END, CASE WHEN q.total + s.w > 400 THEN q.k + 1 ELSE q.k END
  FROM inner_packs q JOIN sentences s ON s.doc_id = q.doc_id AND s.p = q.p AND s.i = q.i + 1
),
units AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS i, w FROM (
    SELECT doc_id, p, 0 AS k, len(ws) AS w FROM counted WHERE len(ws) <= 440
    UNION ALL SELECT doc_id, p, k, sum(w) AS w FROM inner_packs GROUP BY doc_id, p, k
    UNION ALL SELECT doc_id, p, j AS k, least(400, n - 400 * j) AS w FROM long, unnest(range(0, (n - 1) // 400 + 1)) AS r(j) WHERE len(ss) <= 1)
),
packs AS (
  SELECT doc_id, i, w, w AS total, 0 AS seg FROM units WHERE i = 1
  UNION ALL
  SELECT u.doc_id, u.i, u.w, CASE WHEN q.total + u.w > 400 THEN u.w ELSE q.total + u.w END, CASE WHEN q.total + u.w > 400 THEN q.seg + 1 ELSE q.seg END
  FROM packs q JOIN units u ON u.doc_id = q.doc_id AND u.i = q.i + 1
),
segs AS MATERIALIZED (SELECT doc_id, seg, sum(w) AS n FROM packs GROUP BY doc_id, seg),
ended AS (SELECT doc_id, CASE WHEN seg = max(seg) OVER w AND seg > 0 AND n < 40 THEN seg - 1 ELSE seg END AS seg, n FROM segs WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, CAST(seg AS INTEGER) AS seg_idx, CAST(sum(n) AS INTEGER) AS word_count FROM ended GROUP BY doc_id, seg
UNION ALL SELECT doc_id, 0, 0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM paras)
"""


def x30_split_at_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = X.split_at_punctuation(F.col("t"))
    return documents(spark, sf_dir, "text").select("doc_id", X.word_count(F.element_at(halves, 1)).alias("first_words"), F.size(halves).alias("parts"))


QUERIES["x30_split_at_punctuation"] = x30_split_at_punctuation
ORACLES["x30_split_at_punctuation"] = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(w) // 2 AS p, list_filter(range(1, len(w)), lambda i: regexp_matches(w[i], '[.,;:!?—–]$')) AS ends FROM d)
SELECT doc_id, CAST(CASE WHEN n <= 5 THEN n WHEN len(ends) = 0 THEN p
  ELSE list_sort(list_transform(ends, lambda i: abs(i - p) * 1000000000 + i))[1] % 1000000000 END AS INTEGER) AS first_words, CAST(CASE WHEN n <= 5 THEN 1 ELSE 2 END AS INTEGER) AS parts FROM c
"""


def x36_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against outputs that keep a share of their words."""
    v = X.validate(F.col("t"), F.array_join(F.slice(X.words(F.col("t")), 1, F.greatest((X.word_count(F.col("t")) * (F.col("doc_id") % 10 + 1) / 10).cast("int"), F.lit(1))), " "))
    return documents(spark, sf_dir, "text").select("doc_id", v["passed"].alias("passed"), F.round(v["word_ratio"], 6).alias("word_ratio"))


QUERIES["x36_validate"] = x36_validate
ORACLES["x36_validate"] = "SELECT doc_id, CASE WHEN n = 0 THEN true ELSE k / CAST(n AS DOUBLE) >= 0.60 END AS passed, CASE WHEN n = 0 THEN 1.0 ELSE round(k / CAST(n AS DOUBLE), 6) END AS word_ratio FROM (SELECT doc_id, n, greatest(CAST(floor(n * (doc_id % 10 + 1) / 10.0) AS INTEGER), 1) AS k FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents))"


def x34_spoken_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoken form of each figure in a decoration: percent, dollars, quarter, fiscal year, magnitude, year."""
    from speechprep.functions.spoken import spoken_forms

    kinds = {"percent": "cast(doc_id % 97 as string) || '%'", "dollars": "'$' || (doc_id % 90) || '.' || (doc_id % 7)", "quarter": "'Q' || (1 + doc_id % 4) || ' 20' || (10 + doc_id % 90)", "fiscal": "'FY' || (10 + doc_id % 60)", "magnitude": "(1 + doc_id % 19) || ' million'", "year": "cast(1910 + doc_id % 90 as string)"}
    docs = documents(spark, sf_dir, "text").select("doc_id", *[F.expr(e).alias(k) for k, e in kinds.items()])
    return docs.select("doc_id", *[F.element_at(spoken_forms(k), 2).alias(k) for k in kinds])


_TEENS = "['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen']"


def _words_sql(n: str) -> str:
    """Words of a whole number below 100."""
    tens = "['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
    return f"(CASE WHEN {n} < 20 THEN {_TEENS}[{n} + 1] ELSE {tens}[{n} // 10 - 1] || CASE WHEN {n} % 10 = 0 THEN '' ELSE '-' || {_TEENS}[{n} % 10 + 1] END END)"


def _year_sql(century: str, n: str) -> str:
    return f"({_words_sql(century)} || ' ' || CASE WHEN {n} < 10 THEN 'oh ' ELSE '' END || {_words_sql(n)})"


QUERIES["x34_spoken_forms"] = x34_spoken_forms
ORACLES["x34_spoken_forms"] = f"""
SELECT doc_id, {_words_sql('(doc_id % 97)')} || ' percent' AS percent,
  {_words_sql('(doc_id % 90)')} || ' point ' || {_words_sql('(doc_id % 7)')} || ' dollars' AS dollars,
  ['first', 'second', 'third', 'fourth'][1 + doc_id % 4] || ' quarter of ' || {_year_sql('20', '(10 + doc_id % 90)')} AS quarter,
  'fiscal year ' || {_year_sql('20', '(10 + doc_id % 60)')} AS fiscal,
  {_words_sql('(1 + doc_id % 19)')} || ' million' AS magnitude,
  CASE WHEN 10 + doc_id % 90 = 100 THEN 'two thousand' ELSE {_year_sql('19', '(10 + doc_id % 90)')} END AS year
FROM documents
"""


def x34_spoken_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of decorated documents, with their spoken forms, missing from a rewrite that says only some of them."""
    from speechprep.functions.spoken import spoken_forms

    docs = documents(spark, sf_dir, _FACTS)
    found = docs.select("doc_id", F.explode(F.array_distinct(F.transform(X.entities(F.col("t")), lambda e: e["value"]))).alias("value"))
    said = docs.select("doc_id", F.concat(F.lit(_SAID), F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise("")).alias("text"))
    return jobs.missing_entities(found.withColumn("forms", spoken_forms("value")), said)


QUERIES["x34_spoken_entities"] = x34_spoken_entities
#: What odd documents' rewrites say.  A figure counts as said if its words stand there, also inside others: 2, 3, 4, 20, 24 and 2.3.
_SAID = "two point three billion dollars in the third quarter of twenty twenty-four, we are on track today. "
_SAID_SQL = f"""(contains({quoted(_SAID)}, lower(v)) OR v IN ('0002', '0003', '0004', '0020', '0024', '2020', '2024')
  OR (regexp_full_match(v, '[$][0-9][0-9,]*([.][0-9]+)?[.,]*') AND regexp_full_match(replace(v, ',', ''), '[$]0*(2|3|4|20|24|2[.]3)[.]*'))
  OR regexp_full_match(lower(v), '0*(2[.]3|3)[{S.WS}]*billion') OR regexp_full_match(lower(v), 'q3[{S.WS}]*([0-9]{{2,4}})?'))"""
ORACLES["x34_spoken_entities"] = f"""
SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(list_distinct({S.entities("t")})) AS v FROM (SELECT doc_id, {_FACTS} AS t FROM documents WHERE doc_id % 2 = 1)) WHERE NOT {_SAID_SQL}
"""


ORACLES["x27_segment"] = _blanks(ORACLES["x27_segment"])
#: The segments of normalised texts, for the stream that makes them.
SEGMENTS_OF_NORMALISED = ORACLES["x27_segment"].replace("replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents", f"{S.normalized('replace(text, chr(10), chr(10) || chr(10))')} AS t FROM documents")
