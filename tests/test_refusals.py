"""What the vocabularies, catalogues, identifiers and reports refuse or tell."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalise, plugins
from tessera.operators import inventories
from tessera.sources import registry


def letters(spark, text):
    return spark.createDataFrame([(c,) for c in text], "character string")


def test_donors_are_lower_case_then_the_table_then_a_refusal(spark):
    known = letters(spark, "abdjzṣɣ")
    told = {r["character"]: (r["donor"], r["refused"]) for r in inventories.donors(letters(spark, "aƔẒẓǦǧḅЖq"), known, {**inventories.DONORS, "q": "kb"}).collect()}
    assert told == {
        "Ɣ": ("ɣ", None), "Ẓ": ("zṣ", None), "ẓ": ("zṣ", None), "Ǧ": ("dj", None), "ǧ": ("dj", None), "ḅ": ("b", None),
        "Ж": (None, "no donor declared"), "q": (None, "donor cannot be encoded: k"),
    }
    assert {r["donor"] for r in inventories.donors_or_refuse(letters(spark, "Ɣẓ"), known).collect()} == {"ɣ", "zṣ"}
    with pytest.raises(Exception, match="Ж: no donor declared"):
        inventories.donors_or_refuse(letters(spark, "ƔЖ"), known).collect()


def test_symbols_without_a_row_are_named_in_order(spark):
    rows = spark.createDataFrame([("aba",), ("xay",), ("yxax",), ("",), (None,)], "p string")
    got = {r["p"]: (r["e"]["ids"], r["e"]["unmapped"]) for r in rows.select("p", inventories.encoded(F.col("p"), {"a": 4, "b": 9}).alias("e")).collect()}
    assert got["aba"] == ([4, 9, 4], []) and got["xay"] == (None, ["x", "y"]) and got["yxax"] == (None, ["y", "x"]) and got[""] == ([], [])
    assert rows.where("p = 'aba'").select(inventories.encoded_or_refuse(F.col("p"), {"a": 4, "b": 9}).alias("i")).first()["i"] == [4, 9, 4]
    with pytest.raises(Exception, match="no row for x, y in xay"):
        rows.where("p = 'xay'").select(inventories.encoded_or_refuse(F.col("p"), {"a": 4, "b": 9})).collect()
    for wrong in ({"a": 1, "b": 1}, {"ab": 1}):
        with pytest.raises(inventories.VocabularyError):
            inventories.rows_of(wrong)


def test_siblings_do_not_enter_the_corpus(spark):
    entry = {"id": "s", "name": "n", "modality": "text", "access": "open", "uri": "u", "licence": "mit", "languages": ["rif_Latn"], "size": {"rows": 1}}
    siblings = registry.load_siblings(spark, [entry])
    assert "tier" not in siblings.columns and siblings.first()["redistribution"] == "permissive"
    assert registry.find(siblings, language="rif").count() == 1 and registry.find(siblings, language="ri").count() == 0
    with pytest.raises(registry.RegistryError, match="no tier"):
        registry.eligible(siblings, [])
    with pytest.raises(registry.RegistryError, match="unknown fields"):
        registry.load_siblings(spark, [{**entry, "tier": "core"}])
    with pytest.raises(registry.RegistryError, match="repeated"):
        registry.load_siblings(spark, [entry, entry])


def test_an_identifier_gives_only_labels_that_it_states(spark):
    own = plugins.Identifier("toy", "2", frozenset(("a", "b")), lambda: lambda texts: [t[:1] or None for t in texts])
    rows = spark.createDataFrame([("ax",), ("",), ("bx",)], "t string")
    assert [r["x"] for r in rows.select(own.label(F.col("t")).alias("x")).collect()] == ["a", None, "b"]
    assert own.covers("a") and not own.covers("c")
    with pytest.raises(Exception, match="toy 2 gave a label it does not state: c"):
        spark.createDataFrame([("cx",)], "t string").select(own.label(F.col("t")).alias("x")).collect()


def test_folds_are_reported_and_done(spark):
    t = "D\u00e9j\u00e0 vu\u200b \u03b3 \u00c9cole\u00a0\u2013 \u0160arik"
    changes, flags = normalise.report(t, fold=True)
    assert [(k, b, a) for k, _, b, a in changes] == [
        ("diacritic-fold", "\u00e9", "e"), ("diacritic-fold", "\u00e0", "a"), ("invisible-removed", "\u200b", ""), ("homoglyph", "\u03b3", "\u0263"),
        ("diacritic-fold", "\u00c9", "E"), ("whitespace", "\u00a0", " "), ("punctuation", "\u2013", "-"),
    ]
    plain, _ = normalise.report(t)
    assert "diacritic-fold" not in {k for k, *_ in plain}
    row = spark.createDataFrame([(t,)], "t string").select(normalise.normalised(F.col("t"), fold=True).alias("f"), normalise.normalised(F.col("t")).alias("n"), normalise.reported(F.col("t"), fold=True).alias("r")).first()
    assert row["f"].startswith("Deja vu") and "Ecole" in row["f"] and "École" in row["n"]
    assert [c["kind"] for c in row["r"]["changes"]] == [k for k, *_ in changes] and [f["kind"] for f in row["r"]["flags"]] == [k for k, *_ in flags]
