"""Operators over whole tables and whole texts, each with its SQL twin; tests/test_whole.py also holds them against plain Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import corrupt, script, text
from tessera.operators import leaks, masking, scores
from tessera.operators.masking import SpanMasker
from tessera.operators.packing import running
from tessera.plans import forms
from tessera.plans.hygiene import sql_key
from tessera.plans.shared import FULL_ORTHOGRAPHY_SQL, TOKENS, TYPESET_SQL, WORDS, docs, in_full_orthography, squeezed, typeset
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


#: What stands before a word in its pieces, and the longest piece.
METASPACE, MAX_PIECE = "▁", 16

SENTENCE = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: {squeezed('x')}), lambda x: x <> '')"
USABLE = f"""NOT regexp_matches(line, '\\{{\\{{|\\}}\\}}|\\[\\[|\\]\\]|\\||https?://') AND len({TOKENS('line')}) BETWEEN 5 AND 120 AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) > 0
    AND length(regexp_replace(regexp_replace(line, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Latin}}]', '', 'g')) >= 0.8 * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g'))"""
LINE_KEYS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^\\p{L}]+', ' ', 'g'))), lambda k: k <> '')"
KEYS = f"list_filter(list_append({LINE_KEYS}, array_to_string({LINE_KEYS}, ' ')), lambda k: k <> '')"
EMPHASIS = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{N}}])_([^_\\n]{{1,200}})_([^\\p{{L}}\\p{{N}}]|$)', '\\1\\2\\3', 'g')"
PIECES = "flatten(list_transform(range(1, length(m) + 1), lambda i: list_transform(range(1, least(16, length(m) - i + 1) + 1), lambda k: substr(m, i, k))))"


def lowered_rate(rows: DataFrame) -> DataFrame:
    """Edits from each whole text to its lower case by all its characters, for each lang.

    Lower case changes no blank, so both sides have the same pieces between blanks, and every changed letter is
    missing on the other side: the sum over the pieces is the distance of the whole texts."""
    pieces = lambda c: F.split(c, "[ \n]")
    edits = F.aggregate(F.zip_with(pieces(F.col("text")), pieces(F.lower("text")), lambda a, b: F.levenshtein(a, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("lang").agg(F.round(scores.error_rate(edits, F.char_length("text")), 6).alias("cer"))


@query("SELECT lang, round(sum(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))) / sum(length(text)), 6) AS cer FROM documents GROUP BY lang")
def a39_whole_references(spark, sf):
    return lowered_rate(docs(spark, sf))


@query("SELECT doc_id, replace(text, 'e', '') AS kept, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n_removed FROM documents")
def m13_whole_skeletons(spark, sf):
    return docs(spark, sf).select("doc_id", script.skeleton(F.col("text")).alias("s")).select("doc_id", "s.kept", F.size("s.places").cast("long").alias("n_removed"))


def folded(column: str) -> str:
    return f"translate({EMPHASIS.format(EMPHASIS.format(column))}, '{text.FOLD_FROM}', {forms.quoted(text.FOLD_TO)})"


@query(f"SELECT conv_id, turn, {folded('x')} AS folded FROM (SELECT conv_id, turn, {TYPESET_SQL.format('text')} AS x FROM conversations)")
def x16_whole_typography(spark, sf):
    """Turns set in type, with emphasis, quotation marks and dashes."""
    return table(spark, sf, "conversations").select("conv_id", "turn", text.fold_typography(typeset(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, {forms.WIKITEXT} AS plain FROM documents")
def x22_whole_wikitext(spark, sf):
    return docs(spark, sf).select("doc_id", text.strip_wikitext(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, translate(x, 'ɛɣƐƔ', 'εγΣΓ') AS corrupted, CAST(length(regexp_replace(x, '[^ɛɣƐƔ]', '', 'g')) AS INTEGER) AS changed FROM (SELECT doc_id, {FULL_ORTHOGRAPHY_SQL.format('text')} AS x FROM documents)")
def x28_whole_corruption(spark, sf):
    """Texts in the full orthography, of which four letters have look-alikes, and how many are changed."""
    x = in_full_orthography(F.col("text"))
    return docs(spark, sf).select("doc_id", corrupt.lookalike(x).alias("corrupted"), F.regexp_count(x, F.lit("[ɛɣƐƔ]")).alias("changed"))


def pieces_of(word: Column) -> Column:
    """All substrings of 1 to MAX_PIECE characters of the word with its start mark."""
    marked = F.concat(F.lit(METASPACE), word)
    n = F.char_length(marked)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_PIECE), n - i + 1)), lambda k: F.substring(marked, i, k))
    return F.flatten(F.transform(F.sequence(F.lit(1), n), at))


def substring_counts(rows: DataFrame) -> DataFrame:
    """Pieces of the words that occur twice or more in the texts, weighted by the words' counts."""
    counts = rows.select(F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.select("n", F.explode(pieces_of(F.col("w"))).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


@query(f"WITH w AS (SELECT '{METASPACE}' || w AS m, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w HAVING count(*) >= 2), s AS (SELECT n, unnest({PIECES}) AS piece FROM w) SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY piece")
def a21_whole_substring_counts(spark, sf):
    return substring_counts(docs(spark, sf))


def vocabulary_ids(rows: DataFrame) -> DataFrame:
    """The distinct words in ascending order, numbered in cells that are ranges of them, so no task orders all of them or all of
    one letter."""
    words = rows.select(F.explode(text.words(F.col("text"))).alias("word")).distinct().withColumn("all", F.lit(0))
    return running(words, "all", ["word"], F.lit(1), "end", "total").select("word", (F.col("end") - 1).alias("new_id"))


@query(f"SELECT w AS word, row_number() OVER (ORDER BY w) - 1 AS new_id FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)")
def v03_whole_vocabulary(spark, sf):
    return vocabulary_ids(docs(spark, sf))


def pools(rows: DataFrame) -> DataFrame:
    """The distinct usable sentences of each language, rows without one too, and where each is first seen."""
    lines = rows.select("lang", "doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "line"))
    return lines.where(text.usable_line(F.col("line"))).groupBy("lang", "line").agg(F.min(F.struct("doc_id", "place")).alias("first")).select("lang", "line", "first.doc_id", "first.place")


@query(f"""WITH s AS (SELECT lang, doc_id, unnest({SENTENCE}) AS line, generate_subscripts({SENTENCE}, 1) - 1 AS place FROM documents)
    SELECT lang, line, min(doc_id) AS doc_id, CAST(arg_min(place, (doc_id, place)) AS INTEGER) AS place FROM s WHERE {USABLE} GROUP BY lang, line""")
def v21_whole_pools(spark, sf):
    return pools(docs(spark, sf))


def keys(column: Column) -> Column:
    """The keys of the whole text and of each of its lines, those without letters apart."""
    lines = F.filter(F.transform(F.split(column, "\n"), sql_key), lambda k: k != "")
    return F.filter(F.array_union(lines, F.array(F.array_join(lines, " "))), lambda k: k != "")


def without_items(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The doc_ids of the texts of which neither the whole nor any line is a benchmark item or a line of one.

    Texts and items are compared by their letters; lines without letters block nothing."""
    bad = benchmark.select(F.explode(keys(F.col("text"))).alias("bad")).distinct()
    own = rows.where("doc_id IS NOT NULL").select("doc_id", F.explode(keys(F.col("text"))).alias("bad"))
    found = own.join(leaks.bounded(bad), "bad", "left_semi").select("doc_id").distinct()
    return rows.select("doc_id").join(found, "doc_id", "left_anti")


@query(f"WITH b AS (SELECT DISTINCT unnest({KEYS}) AS k FROM benchmark), d AS (SELECT doc_id, unnest({KEYS}) AS k FROM documents) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM d JOIN b USING (k))")
def j01_whole_blocklist(spark, sf):
    return without_items(docs(spark, sf), table(spark, sf, "benchmark"))


def stream_windows(rows: DataFrame, window: int = 64) -> DataFrame:
    """Windows over one stream of all tokens in the order of doc_id: number, and document and token at which it starts.

    Only a remainder shorter than a window is left over. Repeated doc_ids stand in the order of their texts."""
    counted = rows.select("doc_id", F.lit(0).alias("stream"), F.sha2("text", 256).alias("digest"), F.greatest(F.size(text.tokens(F.col("text"))), F.lit(0)).cast("long").alias("n"))
    at = running(counted, "stream", [F.asc_nulls_first("doc_id"), "digest"], F.col("n"), "end", "total").withColumn("offset", F.col("end") - F.col("n"))
    w = F.lit(window)
    first = F.ceil(F.col("offset") / w)
    last = F.least(F.ceil((F.col("offset") + F.col("n")) / w), F.floor(F.col("total") / w)) - 1
    numbers = F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<long>"))
    return at.select("doc_id", "offset", F.explode(numbers).alias("window")).select("window", "doc_id", (F.col("window") * w - F.col("offset")).alias("start"))


@query(
    f"""WITH n AS (SELECT doc_id, len({TOKENS('text')}) AS n, sha256(text) AS digest FROM documents), o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id, digest) - n AS begins, sum(n) OVER () AS total FROM n),
    w AS (SELECT doc_id, begins, unnest(range(CAST(ceil(begins / 64) AS BIGINT), CAST(least(ceil((begins + n) / 64), floor(total / 64)) AS BIGINT))) AS k FROM o) SELECT k AS "window", doc_id, CAST(k * 64 - begins AS BIGINT) AS start FROM w"""
)
def v25_stream_windows(spark, sf):
    return stream_windows(docs(spark, sf))


#: Size of windows and vocabulary of the masks.
WINDOW, MASKS = 64, SpanMasker(vocabulary=16_000, mask_id=4, special=400, random_share=0.1, kept_share=0.1, max_span=3)
MASKED_SHARE = 0.15
IDS_SQL = f"""n AS (SELECT doc_id, {TOKENS('text')} AS t, sha256(text) AS digest FROM documents), o AS (SELECT t, sum(len(t)) OVER (ORDER BY doc_id, digest) - len(t) AS begins FROM n),
    k AS (SELECT unnest(t) AS token, CAST(begins + generate_subscripts(t, 1) - 1 AS BIGINT) AS pos FROM o), w AS (SELECT CAST(pos // {WINDOW} AS BIGINT) AS "window", list(CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {MASKS.vocabulary} ORDER BY pos) AS ids FROM k GROUP BY 1 HAVING count(*) = {WINDOW})"""


def token_stream(rows: DataFrame) -> DataFrame:
    """(at, id): all tokens in the order of doc_id, each with its place in the stream and an id from its digest."""
    counted = rows.select("doc_id", "text", F.lit(0).alias("stream"), F.sha2("text", 256).alias("digest"), F.greatest(F.size(text.tokens(F.col("text"))), F.lit(0)).cast("long").alias("n"))
    placed = running(counted, "stream", [F.asc_nulls_first("doc_id"), "digest"], F.col("n"), "end", "total")
    each = placed.select((F.col("end") - F.col("n")).alias("begins"), F.posexplode(text.tokens(F.col("text"))).alias("i", "token"))
    return each.select((F.col("begins") + F.col("i")).alias("at"), (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % MASKS.vocabulary).alias("id"))


@query(f"WITH {IDS_SQL} SELECT \"window\", array_to_string(ids, ' ') AS ids FROM w")
def v25_window_ids(spark, sf):
    """The windows of the stream of all tokens, as ids."""
    return masking.windows(token_stream(docs(spark, sf)), "at", "id", WINDOW).select("window", F.array_join("ids", " ").alias("ids"))


@query(
    f"""WITH {IDS_SQL}, d AS (SELECT "window", ids, list_transform(range(0, {WINDOW}), lambda i: sha256('mask:' || "window" || ':' || i)) AS d FROM w),
    s AS (SELECT *, flatten(list_transform(range(0, {WINDOW}), lambda k: list_transform(range(0, CAST('0x' || substr(d[k + 1], 1, 13) AS BIGINT) % {MASKS.max_span} + 1), lambda z: k)))[:{WINDOW}] AS span FROM d),
    r AS (SELECT *, list_transform(range(1, {WINDOW + 1}), lambda i: CASE WHEN ids[i] < {MASKS.special} THEN 'z' ELSE substr(d[span[i] + 1], 14, 13) END) AS ratio FROM s),
    t AS (SELECT *, list_sort(ratio)[{int(WINDOW * MASKED_SHARE)}] AS least FROM r)
    SELECT "window", array_to_string(list_transform(range(1, {WINDOW + 1}), lambda i: CASE WHEN ratio[i] > least OR ratio[i] = 'z' THEN ids[i] WHEN substr(d[span[i] + 1], 27, 13) < '{round(MASKS.random_share * 16**13):013x}' THEN CAST('0x' || substr(d[i], 40, 13) AS BIGINT) % {MASKS.vocabulary - MASKS.special} + {MASKS.special}
        WHEN substr(d[span[i] + 1], 27, 13) >= '{round((MASKS.random_share + MASKS.kept_share) * 16**13):013x}' THEN {MASKS.mask_id} ELSE ids[i] END), ' ') AS inputs,
    array_to_string(list_transform(range(1, {WINDOW + 1}), lambda i: CASE WHEN ratio[i] > least OR ratio[i] = 'z' THEN -100 ELSE ids[i] END), ' ') AS labels FROM t"""
)
def v25_span_masks(spark, sf):
    """Masked windows over the whole stream: 15 percent of each by spans, a tenth random and a tenth kept."""
    w = masking.windows(token_stream(docs(spark, sf)), "at", "id", WINDOW)
    return w.withColumn("m", MASKS.masked(F.col("ids"), F.col("window"), MASKED_SHARE)).select("window", F.array_join("m.inputs", " ").alias("inputs"), F.array_join("m.labels", " ").alias("labels"))
