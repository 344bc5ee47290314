"""Words of any length count, and are learned by a digest of the whole word."""

from gridloom.llm.sentences import LONG, learn, shape, word_figures


def test_long_words_are_told_apart(spark):
    run = "今天" * LONG
    docs = spark.createDataFrame([(f"{run} 我们 {run}x.", "zh")] * 3, "text string, lang string")
    got = {r.word: r.bare + r.dotted for r in word_figures(docs, "text", "lang").where("next is null").collect()}
    assert shape(run) != shape(run + "x") and len(shape(run)) <= LONG and shape(run) == shape(run.upper())
    assert got == {shape(run): 3, "我们": 3, shape(run + "x"): 3}
    assert list(learn(docs, "text", "lang").frequent) == ["我们"]  # a digest is no word of a language
