"""Which terms enter the toxicity lexicon."""

from fleetgauge.llm import toxicity


def lexicon(spark, rows):
    return toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))


def test_support_does_not_depend_on_size(spark):
    rare = [("you zorgblat here", 1)] * 3 + [("a quux thing", 1)] * 2
    few = lexicon(spark, rare + [("quite a plain text here", 0)] * 10)
    many = lexicon(spark, rare + [(f"you mudlark{i % 2} again", 1) for i in range(2000)] + [("quite a plain text here", 0)] * 10)
    for terms in (few, many):
        assert any("zorgblat".startswith(t.rstrip("*")) for t in terms) and not any(t.startswith("qu") for t in terms)


def test_no_rank_cut_and_short_words(spark):
    words = [f"{a}{b}{c}x" for a in "bcdfghjklmnpqrst" for b in "aeiouy" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(" ".join(words), 1), (" ".join(words), 1), ("zog " + " ".join(words), 1), ("zog", 1), ("zog", 1), ("mud", 0)]
    terms = lexicon(spark, rows)
    assert len(words) > 2000 and set(words) <= set(terms) and "zog" in terms
