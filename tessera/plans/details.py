"""What operators refuse, report or compare beside their main result: folded accents, donors, rows of symbols, samples, stale
fields, siblings, stated labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import align, corrupt, normalise, phonemes, plugins, text
from tessera.operators import inventories, scores, splits
from tessera.plans import forms
from tessera.plans.shared import ORTHOGRAPHY_SQL, TOKENS, WORDS, docs, in_orthography
from tessera.session import shared_folder, table
from tessera.sources import lexicon, registry

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


FOLDED = normalise.RULES.accents
#: The letters that rules rewrite come first, so an accented one among them is no fold.
FOLDS_SQL = ", ".join(f"({forms.quoted(c)}, {forms.quoted(to)})" for c, to in FOLDED.items() if c not in normalise.RULES.letters)


@query(f"SELECT 'diacritic-fold' AS kind, c AS before, t.b AS after, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS texts FROM (SELECT doc_id, unnest(string_split(nfc_normalize(text), '')) AS c FROM documents) JOIN (VALUES {FOLDS_SQL}) t(a, b) ON c = t.a GROUP BY ALL")
def x03_folded_accents(spark, sf):
    """The changes that the folding of accents adds to the report of edits."""
    found = docs(spark, sf).select("doc_id", normalise.reported(F.col("text"), fold=True).alias("r"))
    changes = found.select("doc_id", F.explode("r.changes").alias("c")).where("c.kind = 'diacritic-fold'")
    return changes.groupBy("c.kind", "c.before", "c.after").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


TABLE = {**inventories.DONORS, "é": "e", "ñ": "n", "ü": "ue", "ß": "sſ", "ó": "o"}
TABLE_SQL = ", ".join(f"({forms.quoted(c)}, {forms.quoted(d)})" for c, d in TABLE.items())


@query(
    f"""WITH k AS (SELECT chr(CAST(c AS INTEGER)) AS k FROM range(97, 123) t(c)), c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}')) AS c FROM documents), m AS (SELECT c, lower(c) AS low FROM c WHERE c NOT IN (SELECT k FROM k)),
    t AS (SELECT * FROM (VALUES {TABLE_SQL}) v(a, d)), s AS (SELECT c, low, low <> c AND low IN (SELECT k FROM k) AS same, coalesce((SELECT d FROM t WHERE a = c), (SELECT d FROM t WHERE a = low)) AS d FROM m),
    b AS (SELECT *, list_sort(list_distinct(list_filter(string_split(d, ''), lambda x: NOT regexp_matches(x, '^[a-z]$')))) AS bad FROM s)
    SELECT c AS character, CASE WHEN same THEN low WHEN d IS NOT NULL AND len(bad) = 0 THEN d END AS donor, CASE WHEN same THEN NULL WHEN d IS NULL THEN 'no donor declared' WHEN len(bad) > 0 THEN 'donor cannot be encoded: ' || array_to_string(bad, ' ') END AS refused FROM b"""
)
def v04_donors_and_refusals(spark, sf):
    """Letters of the documents that a vocabulary of a to z lacks: their donors, or why they are refused."""
    letters = docs(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}"), 0)).alias("character")).distinct()
    known = spark.range(97, 123).select(F.char(F.col("id")).alias("character"))
    return inventories.donors(letters, known, TABLE)


SYMBOLS = {c: i for i, c in enumerate(sorted(set("".join(phonemes.LETTERS)) - set("oc")), start=1)}


#: Of the characters c and their rows i those without a row, in first-seen order.
UNMAPPED_SQL = "array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda k: CASE WHEN i[k] IS NULL AND NOT list_contains(c[1:k - 1], c[k]) THEN c[k] END), lambda x: x IS NOT NULL), '')"


@query(
    f"""WITH w AS (SELECT w AS word, string_split(lower(w), '') AS c FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)), t AS (SELECT word, c, list_transform(c, lambda x: list_position([{', '.join(map(forms.quoted, SYMBOLS))}], x)) AS i FROM w)
    SELECT word, CASE WHEN len(list_filter(i, lambda x: x IS NULL)) = 0 THEN array_to_string(i, ' ') END AS ids, {UNMAPPED_SQL} AS unmapped FROM t"""
)
def v09_rows_or_unmapped(spark, sf):
    """The distinct words by the rows of their letters, two of which have none, or the letters without a row in their order."""
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    e = words.select("word", inventories.encoded(F.lower("word"), SYMBOLS).alias("e"))
    return e.select("word", F.when(F.col("e.ids").isNotNull(), F.array_join(F.transform("e.ids", lambda i: i.cast("string")), " ")).alias("ids"), F.array_join("e.unmapped", "").alias("unmapped"))


CLEAN_SQL = forms.normal_form(ORTHOGRAPHY_SQL.format("text"))


@query(
    f"""WITH d AS (SELECT doc_id, {CLEAN_SQL} AS ref FROM documents ORDER BY md5('eval:' || doc_id), doc_id LIMIT 200), t AS (SELECT ref, translate(ref, 'ɛɣƐƔ', 'εγΣΓ') AS typed FROM d), h AS (SELECT ref, typed, {forms.normal_form('typed')} AS hyp FROM t),
    e AS (SELECT ref, typed, hyp, length(regexp_replace(ref, '[^ɛɣƐƔ]', '', 'g')) AS floor_edits, len(list_filter(range(1, length(ref) + 1), lambda i: ref[i] <> hyp[i])) AS edits FROM h)
    SELECT CAST(count(*) AS BIGINT) AS sentences, round(sum(edits) / sum(length(ref)), 6) AS cer, round(avg(CAST(ref = hyp AS INTEGER)), 6) AS exact, round(sum(floor_edits) / sum(length(ref)), 6) AS floor_cer, round(avg(CAST(ref = typed AS INTEGER)), 6) AS floor_exact FROM e"""
)
def v14_exact_match_on_a_sample(spark, sf):
    """On a drawn sample: error rate and exact matches of restored texts, and of the texts as typed, left alone. The sample is the
    feature."""
    ref = normalise.normalised(in_orthography(F.col("text")))
    drawn = splits.sample(docs(spark, sf).select("doc_id", "text"), "doc_id", 200, "eval").select(ref.alias("ref"))
    rows = drawn.withColumn("typed", corrupt.lookalike(F.col("ref"))).withColumn("hyp", normalise.normalised(F.col("typed")))
    size = F.char_length("ref")
    exact = lambda c: F.round(F.avg((F.col("ref") == F.col(c)).cast("int")), 6)
    edited = rows.withColumns({"e": align.edits(F.col("ref"), F.col("hyp")), "f": align.edits(F.col("ref"), F.col("typed"))})
    share = lambda c: F.round(scores.error_rate(F.col(c), size), 6)
    return edited.agg(F.count("*").alias("sentences"), share("e").alias("cer"), exact("hyp").alias("exact"), share("f").alias("floor_cer"), exact("typed").alias("floor_exact"))


@query(
    f"""WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_transform({TOKENS('text')}, lambda w: regexp_replace(w, '^([a-z]+[aeiou])([a-z]+)$', '\\1-\\2'))) AS w FROM documents) GROUP BY w), s AS (SELECT DISTINCT p FROM (SELECT unnest(string_split(w, '-')) AS p FROM f) WHERE p <> '')
    SELECT CAST(count(*) AS BIGINT) AS types, CAST(count(*) FILTER (contains(w, '-')) AS BIGINT) AS hyphenated, round(sum(n) FILTER (contains(w, '-')) / sum(n), 6) AS token_share, CAST(count(*) FILTER (contains(w, '-') AND n = 1) AS BIGINT) AS hapax,
    CAST((SELECT count(*) FROM s) AS BIGINT) AS split_types, round(1 - (SELECT count(*) FROM s) / count(*), 6) AS reduction FROM f"""
)
def a36_hyphen_split(spark, sf):
    """Types before and after words are split at their hyphens; the words get one after their last vowel but one, as the tables
    hold next to none."""
    planted = F.transform(text.tokens(F.col("text")), lambda w: F.regexp_replace(w, "^([a-z]+[aeiou])([a-z]+)$", "$1-$2"))
    f = docs(spark, sf).select(F.explode(planted).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    has = F.contains(F.col("w"), F.lit("-"))
    whole = f.agg(F.count("*").alias("types"), F.count_if(has).alias("hyphenated"), (F.sum(F.when(has, F.col("n"))) / F.sum("n")).alias("token_share"), F.count_if(has & (F.col("n") == 1)).alias("hapax"))
    split = f.select(F.explode(F.split("w", "-")).alias("p")).where("p <> ''").distinct().agg(F.count("*").alias("split_types"))
    # one row each
    both = whole.join(F.broadcast(split))
    return both.select("types", "hyphenated", F.round("token_share", 6).alias("token_share"), "hapax", "split_types", F.round(1 - F.col("split_types") / F.col("types"), 6).alias("reduction"))


def measures(column):
    paragraphs = F.size(F.filter(F.split(column, r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != ""))
    return {"sha256": F.sha2(column, 256), "bytes": F.octet_length(column), "characters": F.char_length(column), "words": F.size(text.tokens(column)), "paragraphs": paragraphs}


def measures_sql(column: str) -> dict[str, str]:
    return {"sha256": f"sha256({column})", "bytes": f"octet_length(encode({column}))", "characters": f"length({column})", "words": f"len({TOKENS(column)})", "paragraphs": f"len(list_filter(regexp_split_to_array({column}, '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''))"}


#: What a sidecar was written from: an older form of the text.
OLDER_SQL = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN lower(text) WHEN 2 THEN replace(text, 'e', 'é') ELSE replace(text, chr(10), chr(10) || chr(10)) || ' end' END"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {now} <> {then} THEN '{name}' END" for (name, now), then in zip(measures_sql("text").items(), measures_sql("older").values(), strict=True)) + f"], lambda x: x IS NOT NULL), ',') AS stale FROM (SELECT doc_id, text, {OLDER_SQL} AS older FROM documents)")
def a37_stale_fields(spark, sf):
    """The measured fields of each document's sidecar that no longer hold, the sidecars being of older texts."""
    t, d = F.col("text"), F.col("doc_id") % 4
    older = F.when(d == 0, t).when(d == 1, F.lower(t)).when(d == 2, F.replace(t, F.lit("e"), F.lit("é"))).otherwise(F.concat(F.replace(t, F.lit("\n"), F.lit("\n\n")), F.lit(" end")))
    sidecars = docs(spark, sf).select("doc_id", older.alias("older")).select("doc_id", *[v.alias(f"then_{k}") for k, v in measures(F.col("older")).items()])
    now = docs(spark, sf).select("doc_id", *[v.alias(k) for k, v in measures(t).items()])
    stale = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.col(f"then_{k}")), F.lit(k)) for k in measures(t)]))
    return now.join(sidecars, "doc_id").select("doc_id", F.array_join(stale, ",").alias("stale"))


ENTRIES_SQL = "SELECT s_name AS id, 'core' AS tier, CASE s_suppkey % 2 WHEN 0 THEN 'text' ELSE 'speech' END AS modality, CASE s_nationkey % 4 WHEN 0 THEN ['kab_Latn'] WHEN 1 THEN ['fra_Latn', 'kab'] WHEN 2 THEN ['kabx_Latn'] ELSE ['eng'] END AS languages FROM supplier"


@query(f"SELECT id FROM ({ENTRIES_SQL}) WHERE modality = 'text' AND len(list_filter(languages, lambda x: split_part(x, '_', 1) = 'kab')) > 0")
def v17_by_base_language(spark, sf):
    """Sources of one modality that hold a language under any of its regional codes."""
    n = F.col("s_nationkey") % 4
    languages = F.when(n == 0, F.array(F.lit("kab_Latn"))).when(n == 1, F.array(F.lit("fra_Latn"), F.lit("kab"))).when(n == 2, F.array(F.lit("kabx_Latn"))).otherwise(F.array(F.lit("eng")))
    entries = table(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.lit("core").alias("tier"), F.when(F.col("s_suppkey") % 2 == 0, "text").otherwise("speech").alias("modality"), languages.alias("languages"))
    return registry.find(entries, modality="text", language="kab").select("id")


ENGLISH_SQL, FRENCH_SQL = (f"len(list_filter({WORDS}, lambda w: w IN ({', '.join(map(forms.quoted, words))})))" for words in (text.ENGLISH, text.FRENCH))


@query(f"SELECT 'function-words' AS identifier, '1' AS revision, lang, CASE WHEN greatest({ENGLISH_SQL}, {FRENCH_SQL}) = 0 THEN NULL WHEN {ENGLISH_SQL} >= {FRENCH_SQL} THEN 'eng' ELSE 'fra' END AS label, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def z01_stated_identifier(spark, sf):
    """An identifier by function words, with its name and revision beside what it says of each language's documents."""
    english, french = frozenset(text.ENGLISH), frozenset(text.FRENCH)

    def make():
        import regex

        def answer(texts):
            for t in texts:
                words = regex.findall(r"\p{L}+", t.lower())
                a, b = sum(w in english for w in words), sum(w in french for w in words)
                yield None if not a and not b else "eng" if a >= b else "fra"

        return answer

    own = plugins.Identifier("function-words", "1", frozenset(("eng", "fra")), make)
    found = docs(spark, sf).select("lang", own.label(F.col("text")).alias("label"))
    return found.groupBy("lang", "label").agg(F.count("*").alias("n")).select(F.lit(own.name).alias("identifier"), F.lit(own.revision).alias("revision"), "lang", "label", "n")


ATTESTED_SQL = f"SELECT w AS word, CASE WHEN md5(w) < 'c' THEN {forms.ipa('w')} ELSE {forms.ipa('substr(w, 1, length(w) - 1)')} END AS attested FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM benchmark) WHERE length(w) > 1"


@query(
    f"""WITH a AS (SELECT * FROM ({ATTESTED_SQL}) WHERE attested IS NOT NULL AND attested <> ''), d AS (SELECT w AS word, {forms.ipa('w')} AS rule FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents))
    SELECT CASE WHEN attested IS NULL THEN 'not attested' WHEN rule IS NULL THEN 'no reading' WHEN rule = attested THEN 'reproduced' ELSE 'differs' END AS outcome, CAST(count(*) AS BIGINT) AS words FROM d LEFT JOIN a USING (word) GROUP BY 1"""
)
def v15_attested_readings(spark, sf):
    """The words of the documents by what the rules make of the readings that a pronunciation file attests: here that of the
    benchmark's words, some without their last letter."""
    w = F.col("w")
    listed = table(spark, sf, "benchmark").select(F.explode(text.words(F.col("text"))).alias("w")).distinct().where(F.char_length("w") > 1)
    attested = F.when(F.md5("w") < "c", phonemes.ipa(w)).otherwise(phonemes.ipa(F.substring(w, F.lit(1), F.char_length(w) - 1)))
    path = shared_folder(spark, "attested")
    listed.select(F.concat(w, F.lit("\t"), F.coalesce(attested, F.lit("")))).write.text(path)
    known = lexicon.pronunciations(spark, path).select(F.col("orthography").alias("word"), F.col("ipa").alias("attested"))
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct().withColumn("rule", phonemes.ipa(F.col("word")))
    outcome = F.when(F.col("attested").isNull(), "not attested").when(F.col("rule").isNull(), "no reading").when(F.col("rule") == F.col("attested"), "reproduced").otherwise("differs")
    return words.join(known, "word", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("words"))
