"""Vocabularies held against what texts need: donors of missing characters, rows of phoneme symbols. What has no place is refused
by name, never left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the embedding of a character without one of its own starts from.
DONORS = {"ẓ": "zṣ", "ǧ": "dj", "ḅ": "b"}


class VocabularyError(ValueError):
    """A table that places two symbols on one row."""


def literal_map(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def donors(characters: DataFrame, encodable: DataFrame, table: Mapping[str, str] = DONORS) -> DataFrame:
    """characters (character) that are not in encodable (character), each with its donor or the reason why it has none.

    A capital takes its lower case if that can be encoded; else the table's entry for the character or its lower case, all of
    whose characters must be encodable themselves."""
    c = F.col("character")
    known = encodable.select(F.col("character").alias("known")).distinct()
    named = characters.join(known, c == F.col("known"), "left_anti").distinct().withColumn("low", F.lower(c))
    named = named.join(known, F.col("low") == F.col("known"), "left").withColumn("same", (F.col("low") != c) & F.col("known").isNotNull()).drop("known")
    listed = literal_map(table)
    stated = named.withColumn("stated", F.coalesce(F.try_element_at(listed, c), F.try_element_at(listed, F.col("low"))))
    # the table is small, and so are the characters of its entries
    parts = stated.select("stated").distinct().where("stated IS NOT NULL").select("stated", F.explode(F.filter(F.split("stated", ""), lambda x: x != "")).alias("part"))
    bad = parts.join(known, F.col("part") == F.col("known"), "left_anti").groupBy("stated").agg(F.sort_array(F.collect_set("part")).alias("bad"))
    joined = stated.join(bad, "stated", "left")
    reason = F.when(F.col("same"), None).when(F.col("stated").isNull(), F.lit("no donor declared")).when(F.col("bad").isNotNull(), F.concat(F.lit("donor cannot be encoded: "), F.array_join("bad", " ")))
    donor = F.when(F.col("same"), F.col("low")).when(reason.isNull(), F.col("stated"))
    return joined.select("character", donor.alias("donor"), reason.alias("refused"))


def donors_or_refuse(characters: DataFrame, encodable: DataFrame, table: Mapping[str, str] = DONORS) -> DataFrame:
    """(character, donor); the first character without a donor fails the job."""
    told = donors(characters, encodable, table)
    message = F.concat("character", F.lit(": "), "refused")
    return told.select("character", F.when(F.col("refused").isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("donor")).alias("donor"))


def rows_of(symbols: Mapping[str, int]) -> Column:
    """The table of symbols as a map; two symbols on one row, and symbols of no or several characters, are refused."""
    rows = list(symbols.values())
    twice = sorted({r for r in rows if rows.count(r) > 1})
    if twice:
        raise VocabularyError(f"rows with several symbols: {twice}")
    wrong = [s for s in symbols if len(s) != 1]
    if wrong:
        raise VocabularyError(f"no single characters: {wrong}")
    return literal_map(symbols)


def encoded(phonemes: Column, symbols: Mapping[str, int]) -> Column:
    """A struct of the ids of a phoneme string, null if a symbol has no row, and the symbols without one in first-seen order."""
    table = rows_of(symbols)
    chars = F.filter(F.split(phonemes, ""), lambda c: c != "")
    missing = F.array_distinct(F.filter(chars, lambda c: F.try_element_at(table, c).isNull()))
    return F.struct(F.when(F.size(missing) == 0, F.transform(chars, lambda c: F.try_element_at(table, c))).alias("ids"), missing.alias("unmapped"))


def encoded_or_refuse(phonemes: Column, symbols: Mapping[str, int]) -> Column:
    """The ids; a symbol without a row fails the job."""
    found = encoded(phonemes, symbols)
    message = F.concat(F.lit("no row for "), F.array_join(found["unmapped"], ", "), F.lit(" in "), phonemes)
    return F.when(found["ids"].isNull() & phonemes.isNotNull(), F.raise_error(message).cast("array<int>")).otherwise(found["ids"])
