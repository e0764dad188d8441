"""Column choice, plug-ins and seeded corruption."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import corrupt, plugins
from tessera.operators import columns


def test_columns_are_chosen_by_content(spark):
    own = ["Aɣrum d ayen ilhan deg uxxam", "Ur ẓriɣ ara anida yella", "Ḥemmleɣ tamurt-iw"]
    rows = [(o, "this is the house that was there", "le chat est dans la maison", "12", str(i)) for i, o in enumerate(own)]
    df = spark.createDataFrame(rows, "kab string, left string, fra string, number string, doc_id string")
    scored = columns.score_columns(df)
    assert columns.own_column(scored) == "kab"
    assert columns.pair_columns(scored) == ("kab", "fra", "fra")
    assert columns.pair_columns(columns.score_columns(df.drop("fra"))) == ("kab", "left", "eng")
    lying = df.select(F.col("number").alias("kab"), F.col("kab").alias("content"))
    assert columns.own_column(columns.score_columns(lying)) == "content"
    assert columns.own_column(columns.score_columns(df.limit(0))) is None
    assert columns.is_metadata("a.b.doc_id") and columns.is_metadata("x_score") and not columns.is_metadata("text")


def test_plugins_are_made_once_for_each_task(spark):
    def make():
        return lambda texts: [t.upper() for t in texts]

    got = spark.createDataFrame([("a",), ("b",)], "t string").repartition(1).select(plugins.identified(make, F.col("t")).alias("x"))
    assert sorted(r["x"] for r in got.collect()) == ["A", "B"]

    def wrong():
        return lambda rows: [["X"] for _ in rows]

    tokens = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    with pytest.raises(Exception, match="another length"):
        tokens.select(plugins.tagged(wrong, F.col("t"))).collect()


def test_corruption_depends_on_the_text_alone(spark):
    texts = [f"aɣrum-nneɣ deg uxxam {i}" for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", corrupt.misspelled(F.col("t")).alias("x"))
    one, many = ({tuple(r) for r in df.repartition(n).collect()} for n in (1, 7))
    assert one == many
    same = sum(t == x for t, x in one) / len(one)
    assert 0.05 < same < 0.3
    assert all(" ".join(corrupt.chunks(t, 5, 9)) == t for t in texts)


def test_scores_are_those_of_plain_counts_over_all_rows(spark):
    import re

    from tessera.functions import text as texts
    from tessera.operators import columns as chosen

    values = ["Ɣer deg č d ɣef", None, "  ", "ΑΒΓ δεζ ɣ", "the ḍ of, où d", "12.5", "日本 ɛ ţŢ"]
    got = {s.name: s for s in chosen.score_columns(spark.createDataFrame([(i, v, str(i)) for i, v in enumerate(values)], "i int, plain string, digits string"))}
    letters = lambda v: [c for c in v if c.isalpha()]
    latin = [v for v in values if v and v.strip() and letters(v) and sum(c <= "ɏ" or c in texts.MARKED for c in letters(v)) / len(letters(v)) >= texts.LATIN_LEAST]
    words = lambda vs: [w for v in vs if v for w in re.findall(r"[^\W\d_]+", v.lower())]
    share = lambda listed, own: sum(w in listed for w in own) / len(own)
    marked = sum(c in texts.MARKED for v in latin for c in v) / sum(len(letters(v)) for v in latin)
    own = 0.6 * min(marked / 0.08, 1) + 0.4 * min(share(texts.FUNCTION_WORDS, words(latin)) / 0.30, 1)
    s = got["plain"]
    assert (s.own, s.english, s.french, s.coverage, s.numeric) == pytest.approx((own, share(texts.ENGLISH, words(values)), share(texts.FRENCH, words(values)), 5 / 7, False))
    assert got["digits"].numeric and got["digits"].own == 0 and got["digits"].coverage == 1
    assert [x.numeric for x in chosen.score_columns(spark.createDataFrame([], "a string"))] == [True]
