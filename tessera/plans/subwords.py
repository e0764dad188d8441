"""Fertility, token costs and translation scores by subword pieces, over whole texts. The twins merge pairs in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import corrupt, normalise, subword
from tessera.operators import scores
from tessera.plans import forms
from tessera.plans.evaluation import BLEU_SQL, CONDITIONS, ROWS, TYPED, counted
from tessera.plans.shared import docs, in_orthography, pairs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Vocabularies of one public format; the first is the reference.
VOCABULARIES = {"english": "/opt/tokenizers/byte_bpe_50k.tiktoken", "many": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def units_sql(text: str) -> str:
    squeezed = f"regexp_replace(regexp_replace({text}, '[{forms.SPACE}\\x0B\\x1C-\\x1F]+', ' ', 'g'), '^ | $', '', 'g')"
    return f"list_transform([{squeezed}], lambda s: CASE WHEN s = '' THEN [] ELSE regexp_extract_all(' ' || s, '{subword.UNITS.replace(chr(39), chr(39) * 2)}') END)[1]"


def encoded_sql(units: str, vocabulary: str = "english") -> str:
    """e(u, p): the pieces, as hexadecimal bytes, of the distinct u of a table. Two expressions of a recursive WITH."""
    return f"""ranks AS MATERIALIZED (SELECT lower(hex(from_base64(t))) AS h, r FROM read_csv('{VOCABULARIES[vocabulary]}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'INTEGER'}})),
    b AS (SELECT u, list_transform(range(0, strlen(u)), lambda i: lower(hex(encode(u)))[2 * i + 1:2 * i + 2]) AS p, true AS more FROM (SELECT DISTINCT u FROM {units})
    UNION ALL SELECT u, CASE WHEN spot IS NULL THEN p ELSE list_concat(p[:spot - 1], [p[spot] || p[spot + 1]], p[spot + 2:]) END, spot IS NOT NULL
    FROM (SELECT x.u, any_value(x.p) AS p, arg_min(i, r * 1000000000::BIGINT + i) FILTER (r IS NOT NULL) AS spot FROM (SELECT u, p, unnest(range(1, greatest(2, len(p)))) AS i FROM b WHERE more) x LEFT JOIN ranks ON h = x.p[i] || x.p[i + 1] GROUP BY x.u)),
    e AS (SELECT u, p FROM b WHERE NOT more)"""


FALLBACK = "len(list_filter(p, lambda x: length(x) = 2 AND x >= '80'))"


@query(
    f"""WITH RECURSIVE o AS (SELECT lang, unnest({units_sql('text')}) AS u FROM documents), n AS (SELECT lang, u, count(*) AS n FROM o GROUP BY ALL), {encoded_sql('n')},
    f AS (SELECT lang, sum(n) FILTER (u[1] = ' ') AS words, sum(n * len(p)) AS pieces, sum(n * {FALLBACK}) AS parts, count(DISTINCT u) AS units FROM n JOIN e USING (u) GROUP BY lang)
    SELECT lang, CAST(words AS BIGINT) AS words, CAST(pieces AS BIGINT) AS pieces, CAST(parts AS BIGINT) AS parts, CAST(units AS BIGINT) AS units, round(pieces / words, 6) AS fertility, round(pieces / words / (SELECT pieces / words FROM f WHERE lang = 'en'), 6) AS to_reference FROM f"""
)
def a24_subword_fertility(spark, sf):
    """Pieces a word by language and against English, parts of characters among them, and the distinct units that were encoded."""
    counts = subword.unit_counts(docs(spark, sf), "text", subword.ranks(spark, VOCABULARIES["english"]), "lang")
    n, size = F.col("n"), F.size("pieces")
    f = counts.groupBy("lang").agg(
        subword.words_of(F.col("unit"), n).alias("words"), F.sum(n * size).alias("pieces"), F.sum(n * subword.parts_of_characters(F.col("pieces"))).alias("parts"), F.count("*").alias("units")
    ).withColumn("rate", F.col("pieces") / F.col("words"))
    # one row
    english = F.broadcast(f.where("lang = 'en'").select(F.col("rate").alias("english")))
    return f.join(english).select("lang", "words", "pieces", "parts", "units", F.round("rate", 6).alias("fertility"), F.round(F.col("rate") / F.col("english"), 6).alias("to_reference"))


CONDITIONS_SQL = f"SELECT lang, unnest([{{'c': 'typed', 't': {TYPED.format('text')}}}, {{'c': 'repaired', 't': {forms.normal_form(TYPED.format('text'))}}}]) AS s FROM documents"


def conditions(rows):
    """Texts as typed with the letters of another keyboard, and in canonical form."""
    typed = rows.select("lang", corrupt.lookalike(in_orthography(F.col("text"))).alias("t"))
    return typed.select("lang", F.explode(F.create_map(F.lit("typed"), "t", F.lit("repaired"), normalise.normalised(F.col("t")))).alias("condition", "t"))


def cost_sql(vocabulary: str) -> str:
    return f"""(WITH RECURSIVE s AS ({CONDITIONS_SQL}), o AS (SELECT lang, s.c AS condition, unnest({units_sql('s.t')}) AS u FROM s), n AS (SELECT lang, condition, u, count(*) AS n FROM o GROUP BY ALL), {encoded_sql('n', vocabulary)}
    SELECT '{vocabulary}' AS vocabulary, lang, condition, sum(n * len(p)) AS pieces, sum(n * {FALLBACK}) AS parts, sum(n) FILTER (u[1] = ' ') AS words FROM n JOIN e USING (u) GROUP BY ALL)"""


def costs(spark, sf, vocabulary: str):
    counts = subword.unit_counts(conditions(docs(spark, sf)), "t", subword.ranks(spark, VOCABULARIES[vocabulary]), "lang", "condition")
    n = F.col("n")
    return counts.groupBy("lang", "condition").agg(
        F.sum(n * F.size("pieces")).alias("pieces"), F.sum(n * subword.parts_of_characters(F.col("pieces"))).alias("parts"), subword.words_of(F.col("unit"), n).alias("words")
    )


@query(
    f"""SELECT lang, CAST(max(pieces) FILTER (condition = 'typed') AS BIGINT) AS typed, CAST(max(pieces) FILTER (condition = 'repaired') AS BIGINT) AS repaired, CAST(max(parts) FILTER (condition = 'typed') AS BIGINT) AS typed_parts,
    CAST(max(parts) FILTER (condition = 'repaired') AS BIGINT) AS repaired_parts, round(100 * (max(pieces) FILTER (condition = 'typed') - max(pieces) FILTER (condition = 'repaired')) / max(pieces) FILTER (condition = 'repaired'), 6) AS waste FROM {cost_sql('many')} GROUP BY lang"""
)
def v16_subword_costs(spark, sf):
    """What look-alike letters cost: pieces of the texts as typed and repaired, parts of characters among them, and the waste in
    percent of the repaired."""
    of = lambda value, c: F.max(F.when(F.col("condition") == c, F.col(value)))
    a, b = of("pieces", "typed"), of("pieces", "repaired")
    return costs(spark, sf, "many").groupBy("lang").agg(
        a.alias("typed"), b.alias("repaired"), of("parts", "typed").alias("typed_parts"), of("parts", "repaired").alias("repaired_parts"), F.round(100 * (a - b) / b, 6).alias("waste")
    )


@query(f"SELECT vocabulary, lang, condition, CAST(words AS BIGINT) AS words, round(pieces / words, 6) AS fertility, round(parts / pieces, 6) AS unknown FROM (SELECT * FROM {cost_sql('english')} UNION ALL SELECT * FROM {cost_sql('many')})")
def v05_subword_grid(spark, sf):
    """Two vocabularies by two conditions of the text: pieces a word and the share of parts of characters."""
    found = None
    for name in VOCABULARIES:
        one = costs(spark, sf, name).select(F.lit(name).alias("vocabulary"), "lang", "condition", "words", F.round(F.col("pieces") / F.col("words"), 6).alias("fertility"), F.round(F.col("parts") / F.col("pieces"), 6).alias("unknown"))
        found = one if found is None else found.unionByName(one)
    return found


@query(
    f"""WITH RECURSIVE s AS ({CONDITIONS_SQL}), l AS (SELECT s.c AS condition, unnest(regexp_extract_all(s.t, '\\p{{L}}')) AS u FROM s), n AS (SELECT condition, u, count(*) AS n FROM l GROUP BY ALL), {encoded_sql('n')}
    SELECT condition, u AS letter, n AS uses, CAST(len(p) AS INTEGER) AS pieces, len(p) = 1 AS single FROM n JOIN e USING (u)"""
)
def v16_letter_pieces(spark, sf):
    """Each letter that occurs in the texts as typed and as repaired, and whether the vocabulary has it in one piece: a vocabulary
    fitted to wrong letters has those and splits the right ones."""
    characters = conditions(docs(spark, sf)).select("condition", F.explode(F.split("t", "")).alias("letter"))
    counts = characters.groupBy("condition", "letter").agg(F.count("*").alias("uses")).where(F.col("letter").rlike(r"^\p{L}\z"))
    own = F.size(F.get(subword.pieces(F.array("letter"), subword.ranks(spark, VOCABULARIES["english"])), 0))
    return counts.withColumn("pieces", own).select("condition", "letter", "uses", "pieces", (F.col("pieces") == 1).alias("single"))


def subword_bleu_sql(condition: str) -> str:
    ref, hyp = CONDITIONS[condition]
    return f"""(WITH RECURSIVE raw_ AS (SELECT id, {units_sql('ref')} AS ru, {units_sql('hyp')} AS hu FROM (WITH {ROWS.format(ref, hyp)} SELECT * FROM rows_)), u_ AS (SELECT unnest(ru) AS u FROM raw_ UNION ALL SELECT unnest(hu) FROM raw_), {encoded_sql('u_', 'many')},
    m_ AS (SELECT map(list(u), list(p)) AS m FROM e), rows_ AS (SELECT id, flatten(list_transform(ru, lambda x: m[x])) AS ref, flatten(list_transform(hu, lambda x: m[x])) AS hyp FROM raw_, m_), {counted({'w': lambda side: side}, {'w': 4})} {BLEU_SQL})"""


@query(f"SELECT condition, round(bleu, 4) AS bleu FROM (SELECT 'raw' AS condition, {subword_bleu_sql('raw')} AS bleu UNION ALL SELECT 'normalised', {subword_bleu_sql('normalised')})")
def a14_subword_bleu(spark, sf):
    """BLEU over subword pieces from corpus totals, of the replies as typed and of both sides in canonical form."""
    vocabulary = subword.ranks(spark, VOCABULARIES["many"])
    rows = pairs(spark, sf).select(in_orthography(F.col("left_text")).alias("ref"), corrupt.lookalike(in_orthography(F.col("right_text"))).alias("hyp"))
    both = {"raw": rows, "normalised": rows.select(normalise.normalised(F.col("ref")).alias("ref"), normalise.normalised(F.col("hyp")).alias("hyp"))}
    found = None
    for name, own in both.items():
        one = scores.bleu(own, "ref", "hyp", units=lambda c: subword.units(F.col(c)), vocabulary=vocabulary).select(F.lit(name).alias("condition"), F.round("bleu", 4).alias("bleu"))
        found = one if found is None else found.unionByName(one)
    return found


def evaluation_sql(vocabulary: str) -> str:
    return f"""(WITH RECURSIVE o AS (SELECT lang, unnest({units_sql('text')}) AS u FROM documents), n AS (SELECT lang, u, count(*) AS n FROM o GROUP BY ALL), {encoded_sql('n', vocabulary)}
    SELECT '{vocabulary}' AS vocabulary, lang, round(sum(n * len(p)) / sum(n) FILTER (u[1] = ' '), 6) AS pieces_per_word, round(sum(n * len(p)) / (sum(n * length(u))), 6) AS pieces_per_char,
    CAST(count(DISTINCT array_to_string(p, '/')) AS BIGINT) AS distinct_units, CAST(count(*) FILTER (len(p) = 1) AS BIGINT) AS whole, CAST(max(len(p)) AS INTEGER) AS most, CAST(count(*) FILTER (array_to_string(p, '') <> lower(hex(encode(u)))) AS BIGINT) AS not_restored
    FROM n JOIN e USING (u) GROUP BY lang)"""


@query(f"SELECT * FROM {evaluation_sql('english')} UNION ALL SELECT * FROM {evaluation_sql('many')}")
def a38_tokenizer_evaluation(spark, sf):
    """Pieces a word and a character, the distinct units, those of one piece, the most pieces of a unit, and units whose pieces do
    not make up the unit again, by vocabulary and language."""
    found = None
    for name, path in VOCABULARIES.items():
        counts = subword.unit_counts(docs(spark, sf), "text", subword.ranks(spark, path), "lang")
        n, size = F.col("n"), F.size("pieces")
        restored = F.array_join("pieces", "") == F.lower(F.hex(F.encode("unit", "UTF-8")))
        one = counts.groupBy("lang").agg(
            F.round(F.sum(n * size) / subword.words_of(F.col("unit"), n), 6).alias("pieces_per_word"), F.round(F.sum(n * size) / F.sum(n * F.char_length("unit")), 6).alias("pieces_per_char"),
            F.count("*").alias("distinct_units"), F.count_if(size == 1).alias("whole"), F.max(size).alias("most"), F.count_if(~restored).alias("not_restored"),
        ).withColumn("vocabulary", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found
