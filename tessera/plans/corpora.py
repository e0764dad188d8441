"""The catalogue of sources, releases, plug-ins, column choice and corruption on the driver's tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import corrupt, normalise, phonemes, plugins, text
from tessera.operators import columns, lexicon
from tessera.operators.leaks import bounded
from tessera.plans.relations import lexicon as word_list
from tessera.plans import forms, whole
from tessera.plans.shared import FULL_ORTHOGRAPHY_SQL, ORTHOGRAPHY_SQL, TOKENS, WORDS, docs, in_full_orthography, in_orthography, pairs, pairs_sql
from tessera.sources import readers, registry
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: A catalogue made up from the names of the documents' sources.
CATALOGUE_SQL = """SELECT source AS id, CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'cc0-1.0' WHEN 1 THEN 'ODbL ' WHEN 2 THEN 'cc-by-nc-4.0' WHEN 3 THEN 'own' ELSE 'CC-BY-4.0' END AS licence,
    CASE CAST(substr(source, 4) AS INTEGER) % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'supplementary' ELSE 'core' END AS tier, CASE CAST(substr(source, 4) AS INTEGER) % 6 WHEN 5 THEN 'speech' ELSE 'text' END AS modality FROM (SELECT DISTINCT source FROM documents)"""
CLASS_SQL = "CASE lower(trim(licence)) WHEN 'cc0-1.0' THEN 'permissive' WHEN 'cc-by-4.0' THEN 'permissive' WHEN 'odbl' THEN 'share-alike' WHEN 'cc-by-nc-4.0' THEN 'non-commercial' ELSE 'unclear' END"


def catalogue(spark, sf):
    n = F.substring("id", 4, 9).cast("int")
    ids = docs(spark, sf).select(F.col("source").alias("id")).distinct()
    pick = lambda by, named, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in named.items() for x in p]), n % by), F.lit(other))
    licence = pick(5, {0: "cc0-1.0", 1: "ODbL ", 2: "cc-by-nc-4.0", 3: "own"}, "CC-BY-4.0")
    return ids.select("id", licence.alias("licence"), pick(7, {0: "excluded", 1: "supplementary"}, "core").alias("tier"), pick(6, {5: "speech"}, "text").alias("modality")).withColumn("redistribution", registry.redistribution(F.col("licence")))


@query(f"SELECT id FROM ({CATALOGUE_SQL}) WHERE tier <> 'excluded' AND modality <> 'speech' AND id <> 'src3'")
def f02_source_eligibility(spark, sf):
    return registry.eligible(catalogue(spark, sf), ["src3"]).select("id")


@query(f"SELECT doc_id FROM documents JOIN ({CATALOGUE_SQL}) ON id = source WHERE {CLASS_SQL} = 'permissive'")
def f13_permissive_cut(spark, sf):
    return registry.permissive(docs(spark, sf).join(bounded(catalogue(spark, sf)), F.col("id") == F.col("source"))).select("doc_id")


@query(f"SELECT id, {CLASS_SQL} AS redistribution FROM ({CATALOGUE_SQL})")
def f14_redistribution_class(spark, sf):
    return catalogue(spark, sf).select("id", "redistribution")


@query(f"""SELECT DISTINCT name, lower(name) IN ({forms.listed(columns.METADATA)}) OR name LIKE '%\\_id' ESCAPE '\\' OR name LIKE '%\\_score' ESCAPE '\\' AS metadata FROM
    ({' UNION ALL '.join(f"SELECT column_name AS name FROM (DESCRIBE {t})" for t in ('documents', 'pages', 'conversations', 'embeddings'))})""")
def f16_metadata_columns(spark, sf):
    names = [(n, columns.is_metadata(n)) for t in ("documents", "pages", "conversations", "embeddings") for n in table(spark, sf, t).columns]
    return spark.createDataFrame(names, "name string, metadata boolean").distinct()


@query(f"SELECT id, CASE WHEN tier = 'excluded' THEN 'none' WHEN modality = 'speech' THEN 'remote' ELSE 'local' END AS target FROM ({CATALOGUE_SQL})")
def f19_placement(spark, sf):
    place = registry.placement(F.col("tier"), F.col("modality"), F.concat("id", F.lit(".bin")), F.lit(1000))
    return catalogue(spark, sf).select("id", place.alias("target"))


@query(f"WITH s AS (SELECT {CLASS_SQL} AS redistribution, count(*) AS kept FROM documents JOIN ({CATALOGUE_SQL}) ON id = source GROUP BY 1) SELECT redistribution, CAST(kept AS BIGINT) AS kept, round(kept / sum(kept) OVER (), 6) AS share FROM s")
def j13_licence_composition(spark, sf):
    stats = docs(spark, sf).groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("kept"))
    return registry.compose(stats, catalogue(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    f"""WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) ORDER BY
    CASE {CLASS_SQL} WHEN 'permissive' THEN 0 WHEN 'share-alike' THEN 1 WHEN 'unclear' THEN 2 ELSE 3 END, CASE tier WHEN 'core' THEN 0 WHEN 'supplementary' THEN 1 ELSE 3 END, source, doc_id) AS rn FROM documents JOIN ({CATALOGUE_SQL}) ON id = source)
    SELECT doc_id, source FROM k WHERE rn = 1"""
)
def w01_release_priority(spark, sf):
    """First copy wins in the order of redistribution class, tier, source and row."""
    from tessera.operators.dedup import first_copies
    from tessera.plans.hygiene import sql_key

    ranked = lambda t, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in t.items() for x in p]), F.col(c)), F.lit(9))
    rows = docs(spark, sf).join(bounded(catalogue(spark, sf)), F.col("id") == F.col("source")).select("doc_id", "source", sql_key(F.col("text")).alias("key"), ranked(registry.RANK, "redistribution").alias("r"), ranked(registry.TIER_RANK, "tier").alias("t"))
    return first_copies(rows, ["key"], ["r", "t", "source", "doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, CAST(n_chars AS VARCHAR) AS n_chars, lang FROM documents")
def s08_flattened_columns(spark, sf):
    nested = docs(spark, sf).select("doc_id", F.struct("n_chars", F.struct("lang").alias("deep")).alias("about"))
    flat = readers.flattened(nested)
    return flat.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("`about.n_chars`").alias("n_chars"), F.col("`about.deep.lang`").alias("lang"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def s10_record_pairs(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    return rows.join(readers.record_pairs(rows, "text", "role").distinct(), ["text", "role"], "left_semi").select("conv_id", "turn", "text")


@query("SELECT label AS cluster, CAST(len(list_distinct(list(vec_id))) AS BIGINT) AS members FROM embeddings GROUP BY label")
def s22_clusters(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").cast("string").alias("text"))
    found = readers.clusters(e, ["cluster", "label"], ["text"])
    return found.select(F.col("cluster").cast("int").alias("cluster"), F.size("texts").cast("long").alias("members"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN left_text ELSE right_text END AS own, CASE WHEN turn % 4 < 2 THEN right_text ELSE left_text END AS other FROM ({pairs_sql}) WHERE trim(left_text) <> '' AND trim(right_text) <> ''")
def s24_directed_rows(spark, sf):
    p = pairs(spark, sf).withColumn("row", F.concat_ws("/", "conv_id", "turn"))
    rows = p.select(F.col("left_text").alias("source"), F.col("right_text").alias("target"), F.when(F.col("turn") % 4 < 2, "kab-eng").otherwise("eng-kab").alias("direction"), "conv_id", "turn")
    first = F.col("direction") == "kab-eng"
    checked = readers.directed(rows, "kab").select("own", "other").distinct()
    keyed = rows.select("conv_id", "turn", F.when(first, F.col("source")).otherwise(F.col("target")).alias("own"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("other"))
    return keyed.join(checked, ["own", "other"], "left_semi").select("conv_id", "turn", "own", "other")


@query()
def c02_pair_columns(spark, sf):
    """Both text columns of the pairs are scored in one pass; with no marked letters here no own column is claimed."""
    scored = columns.score_columns(pairs(spark, sf))
    return spark.createDataFrame([(s.name, round(s.own, 6), round(s.english, 6), s.language) for s in scored], "name string, own double, english double, language string")


@query(f"SELECT lower(n_name) AS word, {forms.affricates(forms.ipa('lower(n_name)'))} AS ipa FROM nation")
def x15_folded_affricates(spark, sf):
    names = table(spark, sf, "nation").select(F.lower("n_name").alias("word"))
    none = spark.createDataFrame([], "word string, ipa string")
    return phonemes.readings(names, none).select("word", phonemes.fold_affricates(F.col("ipa")).alias("ipa"))


@query(f"SELECT doc_id, {forms.informal('t')} AS informal, t AS canonical FROM (SELECT doc_id, trim({FULL_ORTHOGRAPHY_SQL.format('text')}, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents) WHERE t <> ''")
def x29_informal_spelling(spark, sf):
    """Pairs of an informal and the canonical spelling of each text, in the full orthography; empty texts make none."""
    canonical = F.trim(in_full_orthography(F.col("text")), F.lit(" \t\n\r"))
    return docs(spark, sf).select("doc_id", canonical.alias("canonical")).where("canonical <> ''").select("doc_id", corrupt.misspelled(F.col("canonical")).alias("informal"), "canonical")


@query(f"SELECT doc_id, translate({ORTHOGRAPHY_SQL.format('text')}, 'ɛɣƐƔ', 'εγΣΓ') AS corrupted FROM documents")
def v16_lookalike_condition(spark, sf):
    return docs(spark, sf).select("doc_id", corrupt.lookalike(in_orthography(F.col("text"))).alias("corrupted"))


@query(f"""WITH c AS (SELECT lang, {forms.normal_form(ORTHOGRAPHY_SQL.format('text'))} AS clean FROM documents), b AS (SELECT *, {forms.normal_form("translate(clean, 'ɛɣƐƔ', 'εγΣΓ')")} AS back FROM c)
    SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (back = clean) AS BIGINT) AS restored FROM b GROUP BY lang""")
def v16_repair(spark, sf):
    """Corrupted text comes back under normalisation: the counts of texts that do."""
    there_and_back = normalise.on_texts(lambda t: (clean := normalise.normalise(t)) == normalise.normalise(clean.translate(corrupt.LOOKALIKE_TABLE)), "boolean")
    back = docs(spark, sf).select("lang", there_and_back(in_orthography(F.col("text"))).alias("same"))
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("same").alias("restored"))


@query()
def x32_line_chunks(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(corrupt.chunked(F.col("text"))).alias("place", "line"))


@query(f"""WITH w AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents), r AS (SELECT word, {forms.ipa('word')} AS rule, {forms.ipa("substr(word, 1, 2)")} AS attested FROM w)
    SELECT word, CASE WHEN {forms.sound_count('rule')} > {forms.sound_count('attested')} THEN rule ELSE attested END AS ipa FROM r WHERE rule IS NOT NULL""")
def x33_repaired_readings(spark, sf):
    """Attested readings, here of a word's first two letters, are replaced by the rules' where those have more sounds;
    words outside the writing system have none."""
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    short = words.select("word", phonemes.ipa(F.substring("word", 1, 2)).alias("attested"))
    ruled = short.withColumn("rule", phonemes.ipa(F.col("word")))
    longer = phonemes.sound_count(F.col("rule")) > phonemes.sound_count(F.col("attested"))
    return ruled.where("rule IS NOT NULL").select("word", F.when(longer, F.col("rule")).otherwise(F.col("attested")).alias("ipa"))


@query(f"SELECT doc_id, CAST(len({TOKENS('text')}) AS INTEGER) AS tokens FROM documents")
def z03_injected_counter(spark, sf):
    def make():
        return lambda texts: [len(t.split()) for t in texts]

    return docs(spark, sf).select("doc_id", plugins.counted(make, F.col("text")).alias("tokens"))


@query("SELECT doc_id FROM documents WHERE contains(text, ' the ')")
def z02_language_filter(spark, sf):
    def make():
        return lambda texts: ["eng" if " the " in t else "other" for t in texts]

    return plugins.of_language(docs(spark, sf).select("doc_id", "text"), make, "text", "eng").select("doc_id")


@query(f"SELECT conv_id, turn, round(CASE WHEN length(left_text) > length(right_text) THEN 1.0 ELSE 0.0 END, 1)::DOUBLE AS agreement FROM ({pairs_sql})")
def z05_agreement_scorer(spark, sf):
    def make():
        return lambda rows: [float(len(a) > len(b)) for a, b in rows]

    return pairs(spark, sf).select("conv_id", "turn", plugins.agreement(make, F.col("left_text"), F.col("right_text")).alias("agreement"))


@query(f"SELECT lang, tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, unnest(list_transform({TOKENS('text')}, lambda t: CASE WHEN regexp_full_match(t, '\\p{{Nd}}+') THEN 'NUM' END)) AS tag FROM documents) GROUP BY ALL")
def z04_tagger(spark, sf):
    def make():
        return lambda rows: [["NUM" if t.isdigit() else None for t in tokens] for tokens in rows]

    tokens = text.tokens(F.col("text"))
    tags = docs(spark, sf).select("lang", F.explode(plugins.tagged(make, tokens)).alias("tag"))
    return tags.groupBy("lang", "tag").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, CASE WHEN source IN ('src1', 'src2') THEN 'withheld' END AS reason FROM documents")
def z07_exclusion_reasons(spark, sf):
    reasons = spark.createDataFrame([("src1", "withheld"), ("src2", "withheld")], "source string, reason string")
    return plugins.with_reasons(docs(spark, sf).select("doc_id", "source"), F.broadcast(reasons), "source").select("doc_id", "source", "reason")


@query()
def j09_full_cascade(spark, sf):
    """All five routes, free states too, over the distinct words."""
    entries = word_list(spark, sf).withColumn("source", F.lit("list"))
    words = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return lexicon.analyse(words, entries).groupBy("route").agg(F.countDistinct("word").alias("words"), F.count("*").alias("readings"))


@query("SELECT conv_id AS document, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS pairs FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant')")
def v11_paired_by_stem(spark, sf):
    """Conversations as documents in two languages, one for each role: both sides of a stem are paired where they have as many lines."""
    side = lambda role, n: table(spark, sf, "conversations").where(F.col("role") == role).groupBy(F.col("conv_id").alias("document")).agg(F.count("*").alias(n))
    return side("user", "pairs").join(side("assistant", "others"), "document").where("pairs = others").drop("others")


@query(f"SELECT CAST(count(ipa) AS BIGINT) AS readable, CAST(count(*) FILTER (ipa = attested) AS BIGINT) AS reproduced, CAST(count(*) AS BIGINT) AS words FROM (SELECT {forms.ipa('w')} AS ipa, {forms.ipa('strip_accents(w)')} AS attested FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents))")
def v15_rules_cover(spark, sf):
    """Words that the reading rules take, and whose attested reading, here that without accents, they reproduce, of all."""
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    bare = normalise.on_texts(lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)))(F.col("word"))
    read = words.select(phonemes.ipa(F.col("word")).alias("ipa"), phonemes.ipa(bare).alias("attested"))
    return read.agg(F.count("ipa").alias("readable"), F.count_if(F.col("ipa") == F.col("attested")).alias("reproduced"), F.count("*").alias("words"))


@query(whole.ORACLES["v21_whole_pools"])
def v21_language_pools(spark, sf):
    """Unique usable sentences of each language."""
    return whole.v21_whole_pools(spark, sf)