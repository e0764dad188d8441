"""Tables and SQL pieces that several plan modules use. Each SQL piece is the DuckDB twin of a function in tessera.functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import FOLD_FROM
from tessera.session import table

LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"


def TOKENS(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the turn that answers it: the two-sided records of the pair operators."""
    turns = table(spark, sf, "conversations")
    follow = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.select("conv_id", "turn", "role", F.col("text").alias("left_text"), F.lead("text").over(follow).alias("right_text"), F.lead("role").over(follow).alias("answers"))
    return both.where("role = 'user' AND answers = 'assistant'").select("conv_id", "turn", "left_text", "right_text")


pairs_sql = """SELECT conv_id, turn, text AS left_text, right_text FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS right_text,
lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS answers FROM conversations) WHERE role = 'user' AND answers = 'assistant'"""


def in_orthography(text):
    """The text with two of its letters as those of the orthography that look-alikes exist for: the tables hold none."""
    return F.translate(text, "egEG", "ɛɣƐƔ")


ORTHOGRAPHY_SQL = "translate({}, 'egEG', 'ɛɣƐƔ')"


#: What stands for the letters that informal spelling changes: the tables hold few of them.
STANDING_IN, INFORMAL = "eghklmnrswyzECGS", "ɛɣxčğḍṭṣẓṛḥ-ƐČƔṢ"


def in_full_orthography(text):
    """The text with a letter of its own for each that informal spelling changes, hyphens, and the prepositions it shortens."""
    return F.replace(F.replace(F.translate(text, STANDING_IN, INFORMAL), F.lit(" dɛ "), F.lit(" deg ")), F.lit(" of "), F.lit(" seg "))


FULL_ORTHOGRAPHY_SQL = f"replace(replace(translate({{}}, '{STANDING_IN}', '{INFORMAL}'), ' dɛ ', ' deg '), ' of ', ' seg ')"
#: Letters that stand for the marks of set type.
SET_FROM = "abdfgklmpvwxy"


def typeset(text):
    """The text with words in emphasis and with quotation marks and dashes of set type, which the tables hold none of."""
    return F.translate(F.regexp_replace(text, r" (\p{L}{2,4}) ", " _$1_ "), SET_FROM, FOLD_FROM)


TYPESET_SQL = f"translate(regexp_replace({{}}, ' (\\p{{{{L}}}}{{{{2,4}}}}) ', ' _\\1_ ', 'g'), '{SET_FROM}', '{FOLD_FROM}')"
