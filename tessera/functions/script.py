"""Latin and Tifinagh: one-to-one letters through translate, letter pairs through replace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of both scripts in the same order.
LATIN = "abcdḍefgɣhḥijklmnqrṛsṣtṭuwxyzẓɛ"
TIFINAGH = "ⴰⴱⵛⴷⴹⴻⴼⴳⵖⵀⵃⵉⵊⴽⵍⵎⵏⵇⵔⵕⵙⵚⵜⵟⵓⵡⵅⵢⵣⵥⵄ"
PAIRS = {"č": "ⵜⵛ", "ǧ": "ⴷⵊ"}
LOANS = {"o": "ⵓ", "p": "ⴱ", "v": "ⴼ", "ţ": "ⵜ"}
LABIAL = "ⵯ"


def to_tifinagh(text: Column, faithful: bool = True) -> Column:
    """faithful follows the written convention: no schwa, no hyphen, o p v merged; else both stay and o p v remain Latin."""
    low_only = "".join(c for c in LATIN if not (faithful and c == "e"))
    letters = dict(zip(LATIN, TIFINAGH, strict=True)) | {"ţ": LOANS["ţ"]} | (LOANS if faithful else {})
    sources, targets = "", ""
    for low in [c for c in letters if c in low_only or c in LOANS]:
        for c in dict.fromkeys((low, low.upper())):
            sources, targets = sources + c, targets + letters[low]
    out = F.translate(text, sources + ("eE-" if faithful else ""), targets)
    for latin, both in PAIRS.items():
        for c in (latin, latin.upper()):
            out = F.replace(out, F.lit(c), F.lit(both))
    return out


def to_latin(text: Column) -> Column:
    """The likeliest Latin letters; what the other script does not write stays lost."""
    for latin, both in PAIRS.items():
        text = F.replace(text, F.lit(both), F.lit(latin))
    return F.translate(text, TIFINAGH + LABIAL, LATIN)


def is_tifinagh(text: Column) -> Column:
    return text.rlike("[ⴰ-⵿]")


def table_tifinagh(text: Column) -> Column:
    """The plain table on lower-cased text, nothing dropped."""
    return F.translate(F.lower(text), LATIN, TIFINAGH)


def table_latin(text: Column) -> Column:
    return F.translate(text, TIFINAGH, LATIN)


def round_trip(text: Column) -> Column:
    there = to_tifinagh(text)
    back = to_latin(there)
    return F.struct(
        there.alias("tifinagh"),
        back.alias("recovered"),
        F.regexp_count(F.lower(text), F.lit("e")).cast("long").alias("schwa_lost"),
        F.regexp_count(text, F.lit("-")).cast("long").alias("hyphens_lost"),
        F.regexp_count(there, F.lit("[ⵓⴱⴼ]")).cast("long").alias("ambiguous"),
        (text == back).alias("lossless"),
    )


def skeleton(text: Column) -> Column:
    """The text without schwa, and for each schwa the number of kept characters before it."""
    kept = F.replace(text, F.lit("e"), F.lit(""))
    at = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == "e", i)), lambda x: x.isNotNull())
    places = F.transform(at, lambda p, before: p - before)
    return F.struct(kept.alias("kept"), places.alias("places"))
