"""Language ID of texts of emoji and other astral characters."""

import pyarrow as pa

from speechprep.llm import langid


def test_astral_symbols_are_no_letters():
    texts = ["\U0001f600\U0001f680", "\U0001d11e 12", "\U00020000", "\U0001f600 a", "\U00010400"]
    assert langid.grams(pa.array(texts))[1].tolist() == [False, False, True, True, True]


def test_emoji_are_und(spark):
    rows = spark.createDataFrame([("the dog and the cat", "en"), ("der hund und die katze", "de")], "text string, lang string")
    langs, matrix = langid.train(rows)
    ask = spark.createDataFrame([(1, "\U0001f600 \U0001f680\U0001f680"), (2, "the \U0001f600 dog")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(ask, langs, matrix, ask.doc_id).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"
