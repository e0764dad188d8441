"""Punctuation and case labels of words, and texts restored from them."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import batches

# Marks by label.
LABEL_OF = {",": "COMMA", ".": "PERIOD", "!": "PERIOD", ";": "PERIOD", "?": "QUESTION", ":": "COLON"}
MARK_OF = {"NONE": "", "COMMA": ",", "PERIOD": ".", "QUESTION": "?", "COLON": ":"}
SPEAKABLE = frozenset("abcdefghijklmnqrstuwxyz" + "čḍɛǧɣḥṛṣṭẓ" + "opv" + "- ")


def in_word(c: str) -> bool:
    return c.isalnum() or c == "-"


#: What in_word takes.
RUN = re.compile(r"(?:[^\W_]|-)+")


@cache
def format_characters() -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf") + "]")


def split_words(text: str) -> list[str]:
    """Runs of letters, digits and hyphens of the composed text; invisible format characters vanish, hyphens alone are no word."""
    shown = text if text.isascii() else format_characters().sub("", unicodedata.normalize("NFC", text))
    return [p for p in RUN.findall(shown) if p.strip("-")]


def collation_key(text: str) -> str:
    return " ".join(w.lower() for w in split_words(text))


def annotate(text: str) -> list[tuple[str, str, str]]:
    """(word, mark, case) of each word. A token's mark is the first of its trailing marks; a token without words lends its
    mark to the word before, if that has none."""
    out: list[list[str]] = []
    for token in unicodedata.normalize("NFC", text).split():
        if token.isalnum():
            out.append([token.lower(), "NONE", "UPPER_INIT" if token[0].isupper() else "LOWER"])
            continue
        end = len(token)
        while end and not in_word(token[end - 1]):
            end -= 1
        mark = next((LABEL_OF[c] for c in token[end:] if c in LABEL_OF), "NONE")
        parts = split_words(token)
        for p in parts:
            out.append([p.lower(), "NONE", "UPPER_INIT" if p[0].isupper() else "LOWER"])
        if out and mark != "NONE" and (parts or out[-1][1] == "NONE"):
            out[-1][1] = mark
    return [tuple(x) for x in out]


def spoken(text: str) -> str:
    """Folded, and reduced to what can be spoken: letters of the orthography, hyphens and single blanks."""
    return " ".join("".join(c if c in SPEAKABLE else " " for c in text.casefold()).split())


ANNOTATED = "array<struct<word:string,mark:string,case:string>>"
FIELDS = dict.fromkeys(("word", "mark", "case"), pa.string())


def labelled(texts: list[str | None]) -> pa.Array:
    return batches.lists([None if x is None else annotate(x) for x in texts], FIELDS)


def annotated(text: Column) -> Column:
    """The words with their labels. Composition and Unicode categories need Python; the fan-out follows as explode."""
    return batches.column(labelled, ANNOTATED)(text)


def restored(words: Column) -> Column:
    """The written text from labelled words: the inverse of annotated, built-in functions only."""
    mark = F.create_map(*[F.lit(x) for pair in MARK_OF.items() for x in pair])

    def one(w: Column) -> Column:
        head = F.when(w["case"] == "UPPER_INIT", F.upper(F.substring(w["word"], 1, 1))).otherwise(F.substring(w["word"], 1, 1))
        return F.concat(head, F.substring(w["word"], F.lit(2), F.char_length(w["word"])), F.element_at(mark, w["mark"]))

    return F.array_join(F.transform(words, one), " ")
