"""Queries against their SQL on rows that the generated tables hold rarely."""

import duckdb
from oracle import differences

from speechprep.plans import registry


def agree(spark, path, table, rows, schema, *names):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/{table}.parquet/*.parquet')")
    for name in names:
        assert differences(registry.QUERIES[name](spark, str(path)), con, registry.ORACLES[name]) == "", name


def test_no_temperature(spark, tmp_path):
    rows = [(1, 0.0), (2, None), (3, 0.0), (4, 12.5), (5, 90.0)]
    agree(spark, tmp_path, "events", rows, "event_id long, value double", "n7_quote_params")


def documents(*texts):
    """Each text under an even and an odd number."""
    return [(i, texts[i // 2], f"s{i % 2}") for i in range(2 * len(texts))], "doc_id long, text string, source string"


def test_abbreviations(spark, tmp_path):
    rows = documents("est. est. vs. etc.", "An API-PE of a KPI, e.g. B2B", "éest. _est. (est.", "P&L's aP&L éCEO HR_x UI/UX")
    agree(spark, tmp_path, "documents", *rows, "x20_abbreviations")


def test_normalize(spark, tmp_path):
    rows = documents(
        "a5% 1.2.3% éa@b.co a@b.co.c@d.ee $5B $12.345 $1,2345 $5$6 3xé 2.5X 02nd 101st 24/7",
        "1 a day/Day 0987-14-30 &notit; &#128; R&amp;D <b>x</b> <pre>y</pre> **a* _it_ `c` [3] est. est.",
        "\n|a|\n• item\nSubscribe to it\n## Head\n> q\nhttps://a.b/c www.x.y",
        '<div class="kg-card">z</div>---\na: b\n---\n',
        "",
    )
    agree(spark, tmp_path, "documents", *rows, "x21_normalize")


WORDS = documents("one two　three\x0bfour " * 150 + "\n" + "a5% est. est. <p>x</p> `c` the API " * 40, "", "\n\x0b\n", "Word. " * 500 + "\nA b? “No.\x0bYes” " * 30)


def test_chunks(spark, tmp_path):
    agree(spark, tmp_path, "documents", *WORDS, "x28_chunk_paragraphs")


def test_segment_plan(spark, tmp_path):
    agree(spark, tmp_path, "documents", *WORDS, "a13_segment_plan")


def test_stream_of_segments(spark, tmp_path):
    agree(spark, tmp_path, "documents", *WORDS, "x27_segment", "st9_stream_segments")


def test_clean_for_speech(spark, tmp_path):
    rows = documents("St. St. Co.X Dr.Mr. Sr. Jr.", "Etc. vs.é e.g.i.e. <think>a\nb</THINK>c", "a\x0b\x0b( \x0b)[LONG_PAUSE]x[pause] https://a.b ½ • …")
    agree(spark, tmp_path, "documents", *rows, "x22_clean_for_speech")


def test_artifacts(spark, tmp_path):
    rows = documents("Prose.\nHere. It is.", "  A\nThis passage explores x\nSure, ok\n\n\nb\nI hope it", "Surely\nof  course\nGot it\n\nHereafter\nNote that x", "")
    agree(spark, tmp_path, "documents", *rows, "x23_strip_artifacts")


def test_missing_entities(spark, tmp_path):
    rows = documents("0024 and 2020, 5.2024 or x15% and 2024.5", "$3 $2,0 $2.3 3 billion 4 million Q3 2019", "last week by Bob. On Tue, May 3 2020 of Spain, at 1-2-24", 'to Jane Smith and "quoted text" FY24 12million')
    agree(spark, tmp_path, "documents", *rows, "x34_spoken_entities")
