"""The versioned orthography rules: canonical text, the report of edits and flags, and the duplicate key.

Composition, case folding and the guard of foreign names need Python's Unicode tables, so these are Arrow-batched
functions; each is evaluated once per text before any fan-out.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import batches

RULES_VERSION = "1.0.0"

# The letters of the orthography.
ALPHABET = frozenset("abcdefghijklmnqrstuwxyz" + "ABCDEFGHIJKLMNQRSTUWXYZ" + "čḍɛǧɣḥṛṣṭẓ" + "ČḌƐǦƔḤṚṢṬẒ" + "opv" + "OPV")
# Look-alike letters and their canonical letters.
PRIMARY = {"ε": "ɛ", "Σ": "Ɛ", "γ": "ɣ", "Γ": "Ɣ", "Ԑ": "Ɛ", "ԑ": "ɛ"}
SECONDARY = {
    "ğĝģġǵ": "ǧ", "Ğ": "Ǧ", "ćĉ": "č", "Ć": "Č", "ťțṫ": "ṭ", "Ț": "Ṭ", "ďđðḑ": "ḍ",
    "šśşșṡ": "ṣ", "žźżƶ": "ẓ", "řŕṙŗ": "ṛ", "ı": "i", "İ": "I",
}
DIACRITICS = {
    "áàâäãå": "a", "éèêë": "e", "íìîï": "i", "óòôöõ": "o", "úùûü": "u", "ýÿ": "y", "ñ": "n",
    "ÁÀÂÄÃÅ": "A", "ÉÈÊË": "E", "ÍÌÎÏ": "I", "ÓÒÔÖÕ": "O", "ÚÙÛÜ": "U", "Ñ": "N",
}
PRESERVED = frozenset("\u0163\u0327")
REJECTED = frozenset("çÇħøæœßþʷ")
SPACES = {"\u00a0\u202f\u2007\u2009\u2002\u2003": " ", "\u200b\u200c\u200d\ufeff": ""}
PUNCTUATION = {"\u2010\u2011\u2013\u2014": "-", "\u201c\u201d": '"', "\u2018\u2019\u02bc": "'"}
INVISIBLE = frozenset("\u200b\u200c\u200d\ufeff\u00ad\u2060")


class RuleError(ValueError):
    """The rules contradict each other."""


@dataclass(frozen=True)
class Rules:
    """Character maps; a source may list several characters that share a target."""

    letters: dict[str, str] = field(default_factory=lambda: {**PRIMARY, **SECONDARY})
    accents: dict[str, str] = field(default_factory=lambda: dict(DIACRITICS))
    spaces: dict[str, str] = field(default_factory=lambda: dict(SPACES))
    marks: dict[str, str] = field(default_factory=lambda: dict(PUNCTUATION))
    version: str = RULES_VERSION
    #: What can be a letter of another alphabet.
    odd: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        for name in ("letters", "accents", "spaces", "marks"):
            single = {c: to for sources, to in getattr(self, name).items() for c in sources}
            again = {c for to in single.values() for c in to} & set(single)
            if again:
                raise RuleError(f"{name}: a target is rewritten again: {sorted(again)}")
            object.__setattr__(self, name, single)
        known = re.escape("".join(sorted(ALPHABET | self.letters.keys())))
        object.__setattr__(self, "odd", re.compile(f"[^\\x00-\\x7f{known}]"))


RULES = Rules()
_WORD = re.compile(r"\S+")


@functools.cache
def _foreign(c: str) -> bool:
    parts = unicodedata.normalize("NFD", c)
    return len(parts) > 1 and parts[0].isascii()


def foreign_letter(c: str, rules: Rules = RULES) -> bool:
    """A letter of another alphabet: composed on an ASCII base, in no list of ours."""
    if not c.isalpha() or c in ALPHABET or c in rules.letters or c.lower() in PRESERVED:
        return False
    return _foreign(c)


def guarded(text: str, rules: Rules = RULES) -> list[tuple[int, int]]:
    """Spans of capitalised words that hold a foreign letter: their letters stay as written."""
    foreign = {c for c in set(rules.odd.findall(text)) if foreign_letter(c, rules)}
    if not foreign:
        return []
    return [m.span() for m in _WORD.finditer(text) if (word := m[0])[0].isupper() and not foreign.isdisjoint(word)]


def mapped(text: str, table: dict[str, str]) -> str:
    """The text with the characters of a table replaced, one that occurs after the other: no target is in its own table."""
    for c, to in table.items():
        if c in text:
            text = text.replace(c, to)
    return text


_UNSEEN = dict.fromkeys(INVISIBLE, "")


def _pass(text: str, rules: Rules, fold: bool) -> str:
    shown = unicodedata.normalize("NFC", mapped(text, _UNSEEN))
    out, end = [], 0
    for start, after in guarded(shown, rules) if not rules.letters.keys().isdisjoint(shown) else ():
        out += [mapped(shown[end:start], rules.letters), shown[start:after]]
        end = after
    out = "".join([*out, mapped(shown[end:], rules.letters)])
    for table in (rules.accents,) * fold + (rules.spaces, rules.marks):
        out = mapped(out, table)
    if "\t" in out or "  " in out:
        out = re.sub(r"[ \t]{2,}", " ", out)
    lines = out.split("\n")
    return "\n".join(line.strip() for line in lines).strip()


def normalise(text: str | None, rules: Rules = RULES, fold: bool = False) -> str | None:
    """The canonical form. Passes repeat until nothing changes, since a rewritten letter can compose with a mark that
    follows it; nearly all texts are done after one."""
    if not text:
        return text
    out = _pass(text, rules, fold)
    while not out.isascii() and (again := _pass(out, rules, fold)) != out:
        out = again
    return out


def kinds(rules: Rules, fold: bool) -> dict[str, tuple[str, str]]:
    """{character: (kind of change, what it becomes)}; where several kinds have a character, the first of them counts."""
    tables = [("invisible-removed", dict.fromkeys(INVISIBLE, "")), ("homoglyph", rules.letters), ("diacritic-fold", rules.accents if fold else {}), ("whitespace", rules.spaces), ("punctuation", rules.marks)]
    return {c: (kind, to) for kind, table in reversed(tables) for c, to in table.items()}


def report(text: str, rules: Rules = RULES, fold: bool = False) -> tuple[list[tuple], list[tuple]]:
    """Changes as (kind, position, before, after) and flags as (kind, position, text), by position in the composed text."""
    composed = unicodedata.normalize("NFC", text)
    known = kinds(rules, fold)
    spans = [s for s in guarded(composed, rules) if any(c in rules.letters for c in composed[s[0] : s[1]])]
    inside = {i for start, end in spans for i in range(start, end)}
    changes = [("nfc", 0, text, composed)] if composed != text else []
    changes += [(known[c][0], i, c, known[c][1]) for i, c in enumerate(composed) if c in known and not (known[c][0] == "homoglyph" and i in inside)]
    named = [(i, c, "legacy-t-cedilla" if c in PRESERVED else "rejected-character" if c in REJECTED else "out-of-inventory" if c.isalpha() and c not in ALPHABET and c not in rules.letters else None) for i, c in enumerate(composed)]
    flags = [(kind, i, c) for i, c, kind in named if kind] + [("foreign-proper-noun", start, composed[start:end]) for start, end in spans]
    return changes, flags


def duplicate_key(text: str) -> str:
    """Decomposed, case-folded, all but letters and digits a single space; marks therefore split words."""
    folded = unicodedata.normalize("NFKD", text).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def on_texts(f, returns: str = "string"):
    """An Arrow-batched column function from a function of one text; nulls stay null."""
    return batches.on_values(f, returns)


#: What is white space in ASCII, apart from the line break.
_BLANK = r"[ \t\r\f\x0B\x1C-\x1F]"


def normalised(text: Column, fold: bool = False) -> Column:
    """The canonical form, with fold also without accents. Rules for letters concern no ASCII text, so these take built-in
    functions, only the others Python."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), _BLANK + r"+\n", "\n"), r"\n" + _BLANK + "+", "\n")
    plain = F.regexp_replace(lines, rf"^(?:{_BLANK}|\n)+|(?:{_BLANK}|\n)+\z", "")
    return F.coalesce(on_texts(lambda x: normalise(x, RULES, fold))(F.when(~ascii_, text)), F.when(ascii_, plain))


def fingerprint(text: Column) -> Column:
    """128 bits of the duplicate key, in hex."""
    return on_texts(lambda x: hashlib.md5(duplicate_key(x).encode("utf-8", "surrogatepass")).hexdigest())(text)


REPORT = "changes array<struct<kind:string,position:int,before:string,after:string>>, flags array<struct<kind:string,position:int,text:string>>"
CHANGE = {"kind": pa.string(), "position": pa.int32(), "before": pa.string(), "after": pa.string()}
FLAG = {"kind": pa.string(), "position": pa.int32(), "text": pa.string()}


def both_reports(fold: bool = False):
    """The batch form of report."""

    def both(texts: list[str | None]) -> pa.Array:
        rows = [report(x, RULES, fold) if x else ([], []) for x in texts]
        return pa.StructArray.from_arrays([batches.lists([r[k] for r in rows], fields) for k, fields in enumerate((CHANGE, FLAG))], names=["changes", "flags"])

    return both


def reported(text: Column, fold: bool = False) -> Column:
    """The edits and flags of a text as a struct of two arrays."""
    return batches.column(both_reports(fold), REPORT)(text)


def pair_fingerprint(left: Column, right: Column) -> Column:
    """The key of a pair; the separator between the sides is a blank in the key, as any mark is."""
    return fingerprint(F.concat(left, F.lit("\0"), right))


def described(char: Column) -> Column:
    """A character with its code point and name."""
    return on_texts(lambda c: f"{c} U+{ord(c):04X} {unicodedata.name(c, 'UNNAMED')}")(char)
