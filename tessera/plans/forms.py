"""SQL pieces for the DuckDB twins of the normal forms: each states a rule of tessera.functions again, in SQL's own terms.

Tables of characters are made here from Unicode's data for the Latin blocks and general punctuation, so a twin holds for
texts in these.
"""

from __future__ import annotations

import unicodedata

from tessera.functions import corrupt, labels, normalise, phonemes

#: Blocks whose characters the tables cover.
COVERED = [chr(c) for a, b in ((0x20, 0x250), (0x1E00, 0x1F00), (0x2000, 0x2070)) for c in range(a, b)]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def classed(chars) -> str:
    """A regular expression's class of these characters."""
    return "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in sorted(chars)) + "]"


def listed(chars) -> str:
    return ", ".join(map(quoted, sorted(chars)))


def mapped(text: str, table: dict[str, str]) -> str:
    """text with each character replaced by the table's string, all at once."""
    keys, values = ", ".join(map(quoted, table)), ", ".join(map(quoted, table.values()))
    one = f"CASE WHEN regexp_matches({text}, '{classed(table)}') THEN array_to_string(list_transform(string_split({text}, ''), lambda c: coalesce(list_extract([{values}], list_position([{keys}], c)), c)), '') ELSE {text} END"
    return one


FOLDED = "replace(lower({}), 'ß', 'ss')"

#: Names of the covered characters, and of white space that has none.
NAMES = {c: unicodedata.name(c, "UNNAMED") for c in [*COVERED, "\n", "\t"]}

#: What decomposition makes of a letter, with its marks as blanks, since they split words.
BLANKED = {c: "".join(" " if unicodedata.combining(x) else x for x in unicodedata.normalize("NFKD", c)) for c in COVERED if unicodedata.normalize("NFKD", c) != c}


def duplicate_key(text: str) -> str:
    return f"trim(regexp_replace({FOLDED.format(mapped(text, BLANKED))}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


WORD_RUNS = "list_filter(regexp_extract_all(regexp_replace(nfc_normalize({}), '\\p{{Cf}}', '', 'g'), '[\\p{{L}}\\p{{N}}-]+'), lambda w: trim(w, '-') <> '')"


def collation_key(text: str) -> str:
    return f"array_to_string(list_transform({WORD_RUNS.format(text)}, lambda w: lower(w)), ' ')"


def spoken(text: str) -> str:
    return f"trim(regexp_replace({FOLDED.format(text)}, '[^{''.join(sorted(labels.SPEAKABLE - {' ', '-'}))}-]+', ' ', 'g'))"


SPACE = "\\s\\x{0085}\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}"
FOREIGN = classed(c for c in COVERED if normalise.foreign_letter(c))
LETTER_MAP = normalise.RULES.letters
#: Whether a piece is a capitalised word with a foreign letter.
GUARD = f"regexp_matches(p, '^\\p{{Lu}}') AND regexp_matches(p, '{FOREIGN}')"


def swap(text: str, table: dict[str, str]) -> str:
    """Characters replaced by one character or none."""
    single = {c: to for c, to in table.items() if to}
    gone = [c for c, to in table.items() if not to]
    return f"translate({text}, {quoted(''.join(single) + ''.join(gone))}, {quoted(''.join(single.values()))})"


def normal_form(text: str) -> str:
    """One pass of the orthography's rules."""
    shown = f"nfc_normalize(regexp_replace({text}, '{classed(normalise.INVISIBLE)}', '', 'g'))"
    pieces = f"list_transform(regexp_extract_all(s, '[^{SPACE}]+|[{SPACE}]+'), lambda p: CASE WHEN {GUARD} THEN p ELSE {swap('p', LETTER_MAP)} END)"
    letters = f"CASE WHEN regexp_matches(s, '{classed(LETTER_MAP)}') THEN array_to_string({pieces}, '') ELSE s END"
    letters = f"list_transform([{shown}], lambda s: {letters})[1]"
    plain = f"regexp_replace({swap(swap(letters, normalise.RULES.spaces), normalise.RULES.marks)}, '[ \\t]{{2,}}', ' ', 'g')"
    strip = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    lines = f"array_to_string(list_transform(string_split({plain}, chr(10)), lambda x: {strip('x')}), chr(10))"
    return strip(lines)


#: Flags (doc_id, kind, text) of the documents' composed texts.
FLAGS = f"""chars AS (SELECT doc_id, unnest(string_split(nfc_normalize(text), '')) AS c FROM documents),
    flags AS (SELECT doc_id, CASE WHEN c IN ({listed(normalise.PRESERVED)}) THEN 'legacy-t-cedilla' WHEN c IN ({listed(normalise.REJECTED)}) THEN 'rejected-character'
    WHEN regexp_matches(c, '\\p{{L}}') AND c NOT IN ({listed(normalise.ALPHABET)}) AND c NOT IN ({listed(LETTER_MAP)}) THEN 'out-of-inventory' END AS kind, c AS text FROM chars
    UNION ALL SELECT doc_id, 'foreign-proper-noun', unnest(list_filter(regexp_extract_all(nfc_normalize(text), '[^{SPACE}]+'), lambda p: {GUARD} AND regexp_matches(p, '{classed(LETTER_MAP)}'))) FROM documents)"""
#: A text set to 70 columns.
SET_TO_70 = r"regexp_replace(text, '([^\n]{1,70})[ ]+', '\1' || chr(10), 'g')"
WIKITEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\{\{[^{}]*\}\}', ' ', 'g'), '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g'),
    '(?m)^[=*#:;|!{].*$', ' ', 'g'), '\x27{2,}', ' ', 'g'), '<[^>]+>', ' ', 'g')"""

#: (doc_id, kind, c) of each character that the rules would change, but for guarded words.
CHANGES = " UNION ALL ".join(
    f"SELECT {{key}}, '{kind}' AS kind, c FROM chars WHERE c IN ({', '.join(map(quoted, table))})"
    for kind, table in (("invisible-removed", sorted(normalise.INVISIBLE)), ("homoglyph", LETTER_MAP), ("whitespace", [c for c in normalise.RULES.spaces if c not in normalise.INVISIBLE]), ("punctuation", normalise.RULES.marks))
)


def ipa(word: str) -> str:
    """A word's IPA, null where a letter has no sound."""
    low = f"lower({word})"
    for letter, others in phonemes.FOLDS.items():
        low = f"replace({low}, '{letter}', '{others}')"
    out = low
    doubled = [(c * 2, c + phonemes.LONG) for c in phonemes.LETTERS if c not in phonemes.VOWELS]
    for pattern, sound in [*doubled, *phonemes.rules()]:
        out = f"regexp_replace({out}, '{pattern}', '{sound.replace('$1', chr(92) + '1')}', 'g')"
    out = "translate({}, '{}', '{}')".format(out, *phonemes.swapped())
    for letter, sound in phonemes.spread().items():
        out = f"replace({out}, '{letter}', '{sound}')"
    return f"CASE WHEN regexp_full_match({low}, '[{phonemes.LETTERS}]*') THEN {out} END"


def informal(text: str, seed: str = "informal") -> str:
    """The informal spelling, drawn from digests as tessera.functions.corrupt does."""
    below = lambda h, k, p: f"substr({h}, {1 + corrupt.DIGITS * k}, {corrupt.DIGITS}) < '{corrupt.bound(p)}'"
    cased = lambda to: f"CASE WHEN c = lower(c) THEN {quoted(to)} ELSE {quoted(to[:1].upper() + to[1:])} END"
    one = lambda listed: "CASE " + " ".join(f"WHEN {below('h', 1, end)} THEN {cased(to)}" for to, end in corrupt.cumulated(listed)) + " END"
    table = " ".join(f"WHEN {quoted(c)} THEN CASE WHEN {below('h', 0, corrupt.SUBSTITUTED)} THEN {one(listed)} ELSE c END" for c, listed in corrupt.SPELLINGS.items())
    letter = f"CASE WHEN contains('u{''.join(corrupt.SPELLINGS)}', lower(c)) THEN list_transform([md5(own || ':' || i)], lambda h: CASE lower(c) WHEN 'u' THEN CASE WHEN {below('h', 0, corrupt.OU)} THEN {cased('ou')} ELSE c END {table} END)[1] ELSE c END"
    spelled = f"array_to_string(list_transform(string_split({text}, ''), lambda c, i: {letter}), '')"
    parted = f"CASE WHEN contains(spelled, '-') AND {below('r', 1, corrupt.HYPHEN)} THEN replace(spelled, '-', CASE WHEN {below('r', 2, 0.5)} THEN ' ' ELSE '' END) ELSE spelled END"
    short = "parted"
    for pattern, to in corrupt.SHORT_FORMS:
        for _ in range(2):
            short = f"regexp_replace({short}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    ended = f"list_transform([{parted}], lambda parted: CASE WHEN {below('r', 3, corrupt.SHORTENED)} THEN {short} ELSE parted END)[1]"
    rest = f"list_transform([{spelled}], lambda spelled: {ended})[1]"
    return f"list_transform([sha256('{seed}:' || {text})], lambda own: list_transform([sha256(own || ':row')], lambda r: CASE WHEN {below('r', 0, corrupt.UNCHANGED)} THEN {text} ELSE {rest} END)[1])[1]"


def affricates(sounds: str) -> str:
    for pair, single in phonemes.AFFRICATES.items():
        sounds = f"replace({sounds}, '{pair}', '{single}')"
    return sounds


def sound_count(sounds: str) -> str:
    return f"length(translate({sounds}, 'ːˤ͡', ''))"


def spoken_words(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[\\s\\-]+'), lambda w: trim(w, {quoted(phonemes.EDGE)})), lambda w: w <> '')"


#: Words with their marks and case: a token's mark is the first of its trailing marks; tokens without words lend theirs to the
#: last word before, if that has none.
LABELLED = f"""tok AS (SELECT doc_id, lang, unnest(list_filter(regexp_split_to_array(nfc_normalize(text), '[{SPACE}]+'), lambda x: x <> '')) AS token, generate_subscripts(list_filter(regexp_split_to_array(nfc_normalize(text), '[{SPACE}]+'), lambda x: x <> ''), 1) AS place FROM documents),
    m AS (SELECT *, {WORD_RUNS.format("token")} AS parts, regexp_extract(regexp_extract(token, '[^\\p{{L}}\\p{{N}}-]*$'), '[{''.join(labels.LABEL_OF)}]') AS mark FROM tok),
    g AS (SELECT *, count(*) FILTER (len(parts) > 0) OVER (PARTITION BY doc_id ORDER BY place) AS held FROM m),
    w AS (SELECT doc_id, lang, held, first(parts ORDER BY place) AS parts, arg_min(mark, place) FILTER (mark <> '') AS mark FROM g WHERE held > 0 GROUP BY ALL),
    u AS (SELECT doc_id, lang, held, mark, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM w),
    labelled AS (SELECT doc_id, lang, held, i, lower(part) AS word, CASE WHEN i < n OR mark IS NULL THEN 'NONE' {" ".join(f"WHEN mark = '{m}' THEN '{name}'" for m, name in labels.LABEL_OF.items())} END AS mark, CASE WHEN regexp_matches(part, '^\\p{{Lu}}') THEN 'UPPER_INIT' ELSE 'LOWER' END AS "case" FROM u)"""
RESTORED = f"""CASE WHEN "case" = 'UPPER_INIT' THEN upper(word[1]) ELSE word[1] END || word[2:] || CASE mark {" ".join(f"WHEN '{name}' THEN '{m}'" for name, m in labels.MARK_OF.items())} END"""

#: The text without hard wraps, as text in (doc_id, text).
UNWRAPPED = """lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    sized AS (SELECT *, list_sort(list_transform(list_filter(ls, lambda x: trim(x) <> ''), lambda x: length(rtrim(x)))) AS sizes FROM lines),
    wide AS (SELECT *, sizes[CAST(floor(0.95 * (len(sizes) - 1)) AS INTEGER) + 1] AS width FROM sized),
    fit AS (SELECT *, len(sizes) >= 8 AND width BETWEEN 40 AND 100 AND 2 * len(list_filter(sizes, lambda n: n >= width - 6)) >= len(sizes) AS wrapped FROM wide),
    each AS (SELECT doc_id, width, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM fit WHERE wrapped),
    seen AS (SELECT *, regexp_extract(trim(lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i)), '^[^ \\t]+') AS word, count(*) OVER (PARTITION BY doc_id) AS n FROM each),
    soft AS (SELECT *, trim(line) <> '' AND word <> '' AND length(rtrim(line)) + 1 + length(word) > width AS joins FROM seen),
    glued AS (SELECT doc_id, string_agg(CASE WHEN before THEN ltrim(CASE WHEN joins THEN rtrim(line) ELSE line END) ELSE CASE WHEN joins THEN rtrim(line) ELSE line END END || CASE WHEN joins THEN ' ' WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS text
    FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM soft) GROUP BY doc_id)"""


def aligned(source: str) -> str:
    """The common table expressions for aligned characters (ref_name, hyp_name, place, ref, hyp) of the rows (r, h) of source:
    Levenshtein's table a row at a time, then back from its end, substitutions before gaps."""
    return f"""src AS (SELECT DISTINCT r, h FROM ({source})),
    t AS (SELECT r, h, 0 AS i, [list_transform(range(0, length(h) + 1), lambda j: CAST(j AS BIGINT))] AS rows FROM src
    UNION ALL SELECT r, h, i + 1, list_append(rows, list_transform(range(0, length(h) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k:
        CASE WHEN k = 0 THEN i + 1 ELSE least(rows[i + 1][k] + CASE WHEN r[i + 1] = h[k] THEN 0 ELSE 1 END, rows[i + 1][k + 1] + 1) - k END)))) FROM t WHERE i < length(r)),
    b AS (SELECT r, h, rows, length(r) AS i, length(h) AS j, 0 AS step, '' AS ref, '' AS hyp FROM t WHERE i = length(r)
    UNION ALL SELECT r, h, rows, CASE move WHEN 'h' THEN i ELSE i - 1 END, CASE move WHEN 'r' THEN j ELSE j - 1 END, step + 1, CASE move WHEN 'h' THEN '' ELSE r[i] END, CASE move WHEN 'r' THEN '' ELSE h[j] END
    FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND rows[i + 1][j + 1] = rows[i][j] + CASE WHEN r[i] = h[j] THEN 0 ELSE 1 END THEN 's' WHEN i > 0 AND rows[i + 1][j + 1] = rows[i][j + 1] + 1 THEN 'r' ELSE 'h' END AS move FROM b WHERE i > 0 OR j > 0)),
    pairs_ AS (SELECT r, h, ref, hyp, CAST(max(step) OVER (PARTITION BY r, h) - step AS INTEGER) AS place FROM b WHERE step > 0)"""


def column_of(sql: str, column: str) -> str:
    """A piece that speaks of `text`, for another column."""
    import re

    return re.sub(r"\btext\b", column, sql)


#: Whether an output is empty, loops, stutters, has a gross length or copies its source, over left_text and right_text with
#: token lists lt, rt and word lists lw, rw.
STUTTER = "'(\\b' || w || '\\b|\\b' || w || '[\\s·\\-_]+)'"
LOOPS = " OR ".join(
    f"len(list_filter(range(1, len(rt) - {k * r} + 2), lambda i: rt[i:i + {k * (r - 1) - 1}] = rt[i + {k}:i + {k * r - 1}])) > 0" for k, r in ((1, 3), (2, 3), (3, 4), (4, 4), (5, 4))
)
REPEATS = "(regexp_matches(right_text, '\\b' || w || '\\b([\\s·_-]*' || w || '){2,}') OR len(regexp_extract_all(right_text, '\\b' || w || '[\\s·_-]+')) > 2 AND len(list_filter(list_distinct(regexp_extract_all(right_text, '\\b' || w || '[\\s·_-]+')), lambda x: contains(right_text, x || x || x))) > 0)"
FAILED = f"""(regexp_matches(left_text, '\\p{{L}}') AND NOT regexp_matches(right_text, '\\p{{L}}')) OR {LOOPS} OR len(list_filter(list_distinct(regexp_extract_all(right_text, '\\p{{L}}+')), lambda w: length(w) BETWEEN 2 AND 8 AND {REPEATS})) > 0
    OR (len(lt) >= 4 AND NOT (len(rt) / len(lt) BETWEEN 0.25 AND 3.0)) OR (len(rw) >= 4 AND len(list_filter(rw, lambda w: list_contains(lw, w))) >= 0.75 * len(rw))"""
