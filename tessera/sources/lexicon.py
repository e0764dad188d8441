"""Lexical sources as entries of one shape: form, lemma, upos, feats (a map) and glosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import exact_width, hunspell

# Tense and person labels of the verb tables as feature values.
TENSE = {"aoriste": "Aor", "aoriste intensif": "IntensAor", "prétérit": "Pret", "prétérit négatif": "NegPret", "impératif": "Imp"}
PERSON = {"1s": ("1", "Sing"), "2s": ("2", "Sing"), "3ms": ("3", "Sing"), "3fs": ("3", "Sing"), "1p": ("1", "Plur"), "2mp": ("2", "Plur"), "2fp": ("2", "Plur"), "3mp": ("3", "Plur"), "3fp": ("3", "Plur")}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def features(**named: Column) -> Column:
    """A map of the features that are not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def entries(df: DataFrame, form: Column, lemma: Column | None = None, upos: Column | None = None, feats: Column | None = None, gloss: Column | None = None, source: str = "") -> DataFrame:
    none = F.lit(None).cast("string")
    glosses = F.when(F.coalesce(gloss, F.lit("")) != "", F.array(F.struct(F.lit("fra").alias("lang"), gloss.alias("text")))) if gloss is not None else F.lit(None)
    return df.select(
        form.alias("form"),
        (none if lemma is None else lemma).alias("lemma"),
        (none if upos is None else upos).alias("upos"),
        (F.create_map().cast("map<string,string>") if feats is None else feats).alias("feats"),
        glosses.cast("array<struct<lang:string,text:string>>").alias("glosses"),
        F.lit(source).alias("source"),
    ).where("form <> ''")


def verb_forms(df: DataFrame) -> DataFrame:
    """form, infinitif, tense, person with labels mapped to features; unknown labels give no feature."""
    person = lookup({k: v[0] for k, v in PERSON.items()}, F.lower("person"))
    number = lookup({k: v[1] for k, v in PERSON.items()}, F.lower("person"))
    return entries(df, F.trim("form"), F.trim("infinitif"), F.lit("VERB"), features(Tense=lookup(TENSE, F.lower("tense")), Person=person, Number=number), source="verbs")


def verb_lemmas(df: DataFrame) -> DataFrame:
    yes = lambda c: F.when(F.col(c).cast("boolean"), "Yes")
    return entries(df, F.trim("name"), F.trim("name"), F.lit("VERB"), features(Irregular=yes("isIrregular"), Derived=yes("isDerived")), F.trim("translation"), "verbs")


def toponyms(df: DataFrame, least: int = 3) -> DataFrame:
    """Place names of at least three characters; the filter reaches the scan."""
    rows = df.where(F.char_length("kabyle") >= least)
    return entries(rows, F.col("kabyle"), F.col("kabyle"), F.lit("PROPN"), features(NameType=F.lit("Geo"), GeoCategory=F.nullif("category", F.lit(""))), F.col("french"), "toponyms")


def mathematics(df: DataFrame) -> DataFrame:
    """Terms; main entries and glosses in capitals are lower-cased."""
    plain = lambda c: F.when((F.upper(c) == c) & (F.lower(c) != c), F.lower(c)).otherwise(c)
    own = F.trim("kab")
    return entries(df, F.when(F.col("type") == "main_entry", plain(own)).otherwise(own), feats=features(Domain=F.lit("Math")), gloss=plain(F.trim("fr")), source="maths")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    d = hunspell(spark, path)
    return entries(d, F.col("form"), F.coalesce("lemma", "form"), F.upper("upos"), source="dictionary")


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """Orthography and IPA, both sides non-blank."""
    pairs = exact_width(spark, path, "\t", ["orthography", "ipa"])
    return pairs.select(F.trim("orthography").alias("orthography"), F.trim("ipa").alias("ipa")).where("orthography <> '' AND ipa <> ''")
