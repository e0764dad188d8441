"""Readers on files written from the driver's tables: each query lays a source out as it is found in the wild and reads it back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import corrupt, phonemes, text
from tessera.plans import forms
from tessera.plans.files import folder
from tessera.plans.shared import WORDS, docs, in_orthography, pairs, pairs_sql, squeezed
from tessera.session import table
from tessera.sources import lexicon, readers, registry, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file in the shared folder, whatever its file system."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(data)
    out.close()
    return path


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 nations with their regions: a table of fixed size, for sources that come as single files."""
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey")


NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"


@query("SELECT item_id, text FROM benchmark")
def s03_json_document(spark, sf):
    """One array of records in one file, found by its suffix."""
    path = f"{folder(spark, 'array')}.json"
    record = F.to_json(F.struct("item_id", "text"))
    table(spark, sf, "benchmark").select(record.alias("r")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]"))).write.text(path)
    return readers.by_suffix(spark, path).select("item_id", "text")


def bundle(spark, sf) -> str:
    rows = nations(spark, sf).collect()
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("n.en-kab.kab", "".join(f" {r['n_name']} \n" if r["n_nationkey"] % 5 else "\n" for r in rows))
        z.writestr("n.en-kab.en", "".join(f"{r['r_name']}\n" if r["n_nationkey"] % 7 else " \n" for r in rows))
        z.writestr("n.en-kab.xml", "<x/>")
    return put(spark, f"{folder(spark, 'bundle')}.zip", data.getvalue())


@query("SELECT n_nationkey AS line, n_name AS text FROM nation WHERE n_nationkey % 5 <> 0")
def s05_bundle_lines(spark, sf):
    return readers.by_suffix(spark, bundle(spark, sf)).select(F.col("line").cast("int").alias("line"), "text")


@query(f"SELECT n_nationkey AS line, n_name AS kab, r_name AS en FROM {NATIONS} WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0")
def s09_bundle_pairs(spark, sf):
    return readers.zip_pairs(spark, bundle(spark, sf), "kab", "en").select(F.col("line").cast("int").alias("line"), "kab", "en")


@query(f"SELECT 'part' || part || '.en-kab.kab' AS member, kab, en, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id % 4 AS part, {squeezed('left_text')} AS kab, {squeezed('right_text')} AS en FROM ({pairs_sql})) WHERE kab <> '' AND en <> '' GROUP BY ALL")
def s09_turns_by_member(spark, sf):
    """Questions and answers as bundles of four pairs of members, one from each task, each member read by a task of its own."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    part = F.coalesce((F.col("conv_id") % 4).cast("string"), F.lit(""))
    rows = pairs(spark, sf).select(F.concat(F.lit("part"), part, F.lit(".en-kab")).alias("stem"), squeeze("left_text").alias("kab"), squeeze("right_text").alias("en"))
    path = folder(spark, "turns")
    sinks.zip_pairs(rows, "stem", "kab", "en", path)
    found = readers.zip_pairs(spark, path, "kab", "en").withColumn("member", F.nullif("member", F.lit("part.en-kab.kab")))
    return found.groupBy("member", "kab", "en").agg(F.count("*").alias("n"))


@query("SELECT unnest(['.csv', '.jsonl', '.parquet', '.tsv', '.txt']) AS suffix, CAST(count(*) AS BIGINT) AS n, min(n_name) AS least FROM nation")
def s07_by_suffix(spark, sf):
    """One table in five formats; the reader follows from the suffix."""
    rows = table(spark, sf, "nation").select("n_name")
    single = rows.coalesce(1)
    write = {".csv": lambda p: single.write.option("header", True).csv(p), ".tsv": lambda p: single.write.option("header", True).csv(p), ".jsonl": rows.write.json, ".parquet": rows.write.parquet, ".txt": rows.write.text}
    found = None
    for suffix, sink in write.items():
        path = f"{folder(spark, 'any')}{suffix}"
        sink(path)
        got = readers.by_suffix(spark, path)
        own = got.select(F.lit(suffix).alias("suffix"), F.col(got.columns[0]).alias("name")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("name").alias("least"))
        found = own if found is None else found.unionByName(own)
    return found


@query(f"SELECT left_text, right_text, CAST(count(*) AS BIGINT) AS n FROM ({pairs_sql}) WHERE turn % 3 <> 0 GROUP BY ALL")
def s10_pairs_read(spark, sf):
    rows = pairs(spark, sf).withColumn("right_text", F.when(F.col("turn") % 3 != 0, F.col("right_text")))
    return readers.record_pairs(rows, "left_text", "right_text").groupBy("left_text", "right_text").agg(F.count("*").alias("n"))


def treebank(spark, sf) -> DataFrame:
    """Each document as one sentence of its words, with a class by their lengths; every seventh word and the next one are
    one surface token."""
    path = f"{folder(spark, 'bank')}.conllu"
    own = text.words(F.col("text"))
    upos = lambda w: F.when(F.char_length(w) % 3 == 0, "NOUN").when(F.char_length(w) % 3 == 1, "VERB").otherwise("ADP")
    tab, blanks = F.lit("\t"), lambda n: F.lit("\t_" * n)

    def row(words):
        def one(w, i):
            n = (i + 1).cast("string")
            plain = F.concat(n, tab, w, tab, w, tab, upos(w), blanks(6))
            span = F.concat(n, F.lit("-"), (i + 2).cast("string"), tab, w, F.get(words, i + 1), blanks(8))
            return F.when((i % 7 == 0) & (i + 1 < F.size(words)), F.concat_ws("\n", span, plain)).otherwise(plain)

        return F.array_join(F.transform(words, one), "\n")

    rows = docs(spark, sf).select("doc_id", own.alias("w")).where(F.size("w") > 0)
    rows.select(F.concat(F.lit("# sent_id = "), F.col("doc_id").cast("string"), F.lit("\n"), row(F.col("w"))).alias("value")).write.option("lineSep", "\n\n").text(path)
    return readers.by_suffix(spark, path)


BANK = f"bank AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)"
SPANS = "CAST(floor((n - 2) / 7) + 1 AS BIGINT)"


@query(f"WITH {BANK} SELECT CAST(doc_id AS VARCHAR) AS sent_id, CAST(n AS INTEGER) AS words, CAST(n - CASE WHEN n > 1 THEN {SPANS} ELSE 0 END AS INTEGER) AS tokens FROM bank")
def s11_treebank(spark, sf):
    return treebank(spark, sf).select("sent_id", F.size("words").alias("words"), F.size("tokens").alias("tokens"))


UPOS_SQL = "CASE length({0}) % 3 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' ELSE 'ADP' END"


@query(f"SELECT form, {UPOS_SQL.format('form')} AS upos, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({WORDS}) AS form FROM documents) GROUP BY form")
def v19_treebank_words(spark, sf):
    return readers.treebank_words(treebank(spark, sf)).groupBy("form", "upos").agg(F.count("*").alias("n"))


@query(
    f"""WITH {BANK}, u AS (SELECT doc_id, n, unnest(w) AS form, generate_subscripts(w, 1) - 1 AS i FROM bank),
    p AS (SELECT 'words' AS setting, {UPOS_SQL.format('form')} AS gold, i, form FROM u UNION ALL SELECT 'tokens', CASE WHEN i % 7 = 0 AND i + 1 < n THEN NULL ELSE {UPOS_SQL.format('form')} END, i, form FROM u WHERE NOT (i % 7 = 1))
    SELECT setting, gold, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (contains(form, 'e') OR contains(form, 'g')) AS BIGINT) AS changed FROM p WHERE gold IS NOT NULL GROUP BY ALL"""
)
def v20_scoring_positions(spark, sf):
    """Both settings, read under the look-alike condition; positions without gold are no part of the score. A sentence is parsed
    once for both, and a form changed once for all its positions."""
    settings = F.array(*[F.struct(F.lit(name).alias("setting"), readers.positions(name == "words").alias("own")) for name in ("words", "tokens")])
    rows = treebank(spark, sf).select(F.inline(settings)).select("setting", F.inline("own")).where("gold IS NOT NULL")
    forms_ = rows.groupBy("setting", "gold", "form").agg(F.count("*").alias("n"))
    changed = corrupt.lookalike(in_orthography(F.col("form"))).rlike("[εγ]")
    return forms_.groupBy("setting", "gold").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("changed"))


@query("SELECT 's' || s_suppkey || '.mp3' AS path, CAST(s_nationkey AS VARCHAR) AS client_id, s_name AS sentence, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey * 7 AS BIGINT) END AS duration_ms FROM supplier WHERE s_suppkey % 10 <> 1")
def s12_speech_rows(spark, sf):
    """Transcripts with surplus tabs go, clips without a duration stay."""
    clips, lengths = f"{folder(spark, 'clips')}.tsv", f"{folder(spark, 'durations')}.tsv"
    s = table(spark, sf, "supplier").withColumn("path", F.concat(F.lit("s"), "s_suppkey", F.lit(".mp3")))
    s.select(F.concat_ws("\t", F.col("s_nationkey").cast("string"), "path", F.when(F.col("s_suppkey") % 10 == 1, F.concat("s_name", F.lit("\tmore"))).otherwise(F.col("s_name")))).write.text(clips)
    s.where("s_suppkey % 3 <> 0").select(F.concat_ws("\t", "path", (F.col("s_suppkey") * 7).cast("string"))).write.text(lengths)
    return readers.speech_rows(spark, clips, lengths, ["client_id", "path", "sentence"]).select("path", "client_id", "sentence", "duration_ms")


@query("SELECT CASE item_id % 2 WHEN 0 THEN 'dev' ELSE 'devtest' END AS split, item_id // 2 AS id, text, '' AS domain FROM benchmark")
def s13_benchmark_splits(spark, sf):
    """Ids start anew in each split."""
    root = folder(spark, "splits")
    rows = table(spark, sf, "benchmark").withColumn("id", F.floor(F.col("item_id") / 2).cast("long"))
    for k, name in enumerate(("dev", "devtest")):
        rows.where(F.col("item_id") % 2 == k).select("id", "text").write.json(f"{root}/{name}/kab_Latn.jsonl")
    return readers.splits(spark, root, "kab_Latn", ["dev", "devtest"]).select("split", "id", "text", "domain")


#: The mark of an encoded text, and what encodes one: characters outside XML 1.0, or the mark itself.
ENCODED = "\ufdd0"
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF\uFDD0]"


@query("SELECT CAST(doc_id AS VARCHAR) AS title, trim(text, ' ' || chr(10) || chr(9)) AS text FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''")
def s15_dump_pages(spark, sf):
    """Documents as pages of a dump. A text with characters that no XML can hold goes percent-encoded, after a mark."""
    path = f"{folder(spark, 'dump')}.xml"
    own = F.col("text")
    held = F.when(own.rlike(NO_XML), F.concat(F.lit(ENCODED), F.url_encode(own))).otherwise(own)
    pages = docs(spark, sf).select(F.col("doc_id").cast("string").alias("title"), F.struct(held.alias("text")).alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    decoded = readers.bare(F.url_decode(F.substring(own, F.lit(2), F.char_length(own))))
    found = readers.by_suffix(spark, path).select("title", F.when(F.startswith(own, F.lit(ENCODED)), decoded).otherwise(own).alias("text"))
    return found.where("text <> ''")


def dictionary_file(spark, sf) -> str:
    path = folder(spark, "dic")
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    tags = F.when(F.col("n") > 1, F.concat(F.lit(" po:noun st:"), F.substring("w", 1, 3))).otherwise("")
    entry = F.concat("w", F.when(F.col("n") % 2 == 0, F.lit("/AB")).otherwise(""), tags)
    words.select(entry.alias("value")).unionByName(spark.createDataFrame([("12345",)], "value string")).write.text(path)
    return path


@query(f"SELECT w AS form, CASE WHEN n % 2 = 0 THEN 'AB' END AS flags, CASE WHEN n > 1 THEN 'noun' END AS upos, CASE WHEN n > 1 THEN substr(w, 1, 3) END AS lemma FROM (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w)")
def s16_hunspell(spark, sf):
    return readers.hunspell(spark, dictionary_file(spark, sf)).select("form", "flags", "upos", "lemma")


def case_of(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {forms.quoted(v)}" for i, v in enumerate(values)) + " END"


@query(
    f"""SELECT p_name AS form, p_brand AS lemma, 'VERB' AS upos, 'Number=' || {case_of('p_partkey % 9', [v[1] for v in lexicon.PERSON.values()])} || '|Person=' || {case_of('p_partkey % 9', [v[0] for v in lexicon.PERSON.values()])}
    || CASE WHEN p_size % 6 < 5 THEN '|Tense=' || {case_of('p_size % 6', lexicon.TENSE.values())} ELSE '' END AS feats FROM part"""
)
def s17_verb_forms(spark, sf):
    """Labels of tense and person become features; an unknown tense gives none."""
    pick = lambda column, values: F.element_at(F.array(*map(F.lit, values)), column + 1)
    part = table(spark, sf, "part")
    tense = pick(F.col("p_size") % 6, [*lexicon.TENSE, "inconnu"])
    rows = part.select(F.concat(F.lit(" "), "p_name").alias("form"), F.col("p_brand").alias("infinitif"), F.upper(tense).alias("tense"), pick((F.col("p_partkey") % 9).cast("int"), list(lexicon.PERSON)).alias("person"))
    return lexicon.verb_forms(rows).select("form", "lemma", "upos", text.feature_string(F.col("feats")).alias("feats"))


@query("SELECT n_name AS form, 'Geo' AS name_type, CASE WHEN n_nationkey % 2 = 0 THEN 'city' END AS category, r_name AS gloss FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) >= 6")
def s18_toponyms(spark, sf):
    rows = nations(spark, sf).select(F.col("n_name").alias("kabyle"), F.col("r_name").alias("french"), F.when(F.col("n_nationkey") % 2 == 0, "city").otherwise("").alias("category"))
    return lexicon.toponyms(rows, least=6).select("form", F.col("feats")["NameType"].alias("name_type"), F.try_element_at("feats", F.lit("GeoCategory")).alias("category"), F.col("glosses")[0]["text"].alias("gloss"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS form, lower(r_name) AS gloss FROM nation JOIN region ON n_regionkey = r_regionkey")
def s19_mathematics(spark, sf):
    """Main entries in capitals are lower-cased, others stay."""
    rows = nations(spark, sf).select(F.col("n_name").alias("kab"), F.col("r_name").alias("fr"), F.when(F.col("n_nationkey") % 2 == 0, "main_entry").otherwise("sub_entry").alias("type"))
    return lexicon.mathematics(rows).select("form", F.col("glosses")[0]["text"].alias("gloss"))


@query(
    """WITH n AS (SELECT translate(lower(n_name), ' _0123456789', '--abcdefghij') AS head, n_nationkey AS k FROM nation)
    SELECT head, head AS form, 'head' AS kind FROM n UNION ALL SELECT head, 'i' || head || 'en', 'plural' FROM n WHERE k % 2 = 0 UNION ALL SELECT head, 'u' || head, 'annexed' FROM n WHERE k % 3 = 0"""
)
def s20_dictionary_posts(spark, sf):
    path = f"{folder(spark, 'posts')}.csv"
    head = F.translate(F.lower("n_name"), " _0123456789", "--abcdefghij")
    more = lambda by, *parts: F.when(F.col("n_nationkey") % by == 0, F.concat(*parts)).otherwise("")
    content = F.concat(F.lit('<p class="g">gloss, "quoted"</p>\n'), more(2, F.lit("plural: i"), head, F.lit("en\n")), more(3, F.lit("Annexed = u"), head))
    nations(spark, sf).select(head.alias("post_title"), content.alias("post_content")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.dictionary_posts(spark, path).select("head", "form", "kind")


@query(f"SELECT w AS orthography, ipa FROM (SELECT w, {forms.ipa('w')} AS ipa FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)) WHERE ipa IS NOT NULL")
def s21_pronunciations(spark, sf):
    """Words without a reading have a blank side and go."""
    path = f"{folder(spark, 'ipa')}.tsv"
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("w")).distinct()
    words.select(F.concat(F.col("w"), F.lit("\t "), F.coalesce(phonemes.ipa(F.col("w")), F.lit("")))).write.text(path)
    return lexicon.pronunciations(spark, path)


@query(f"SELECT trim(left_text) AS own, trim(right_text) AS other, CASE turn % 3 WHEN 0 THEN 'eng' WHEN 1 THEN 'fra' ELSE 'fra' END AS code, CAST(count(*) AS BIGINT) AS n FROM ({pairs_sql}) GROUP BY ALL")
def s23_pair_rows(spark, sf):
    """Three layouts: a column for each language, source and target, and target and source with the language from the file's name."""
    p = pairs(spark, sf)
    part = lambda k: p.where(F.col("turn") % 3 == k)
    named = part(0).select(F.col("left_text").alias("kab"), F.col("right_text").alias("eng"), F.lit("").alias("fra"))
    stated = part(1).select(F.col("left_text").alias("src_text"), F.col("right_text").alias("tgt_text"), F.lit("kab").alias("src_lang"), F.lit("fra").alias("tgt_lang"))
    guessed = part(2).select(F.col("right_text").alias("source"), F.col("left_text").alias("target"))
    rows = readers.pair_rows(named).unionByName(readers.pair_rows(stated)).unionByName(readers.pair_rows(guessed, named="fra-x.jsonl"))
    return rows.groupBy("own", "other", "code").agg(F.count("*").alias("n"))


@query("SELECT text, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text")
def s25_corpus_texts(spark, sf):
    path = f"{folder(spark, 'texts')}.jsonl"
    docs(spark, sf).select("doc_id", "text").write.json(path)
    return readers.texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT n_name AS text FROM nation WHERE n_nationkey % 4 <> 0")
def s26_seed_column(spark, sf):
    path = f"{folder(spark, 'seed')}.tsv"
    surplus = F.when(F.col("n_nationkey") % 4 == 0, F.lit("\tsurplus")).otherwise("")
    nations(spark, sf).select(F.concat(F.col("n_nationkey").cast("string"), F.lit('\t"kab\t'), "n_name", surplus)).write.text(path)
    return readers.column_of(spark, path, 3, 2)


@query("SELECT CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE n_name END AS text FROM nation WHERE n_nationkey % 4 <> 3")
def s27_set_lines(spark, sf):
    """Plain lines, records with either field, and broken records, which go."""
    path = f"{folder(spark, 'ocr')}.txt"
    record = lambda name: F.to_json(F.struct(F.col("n_name").alias(name)))
    line = F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).when(F.col("n_nationkey") % 4 == 1, record("kab")).when(F.col("n_nationkey") % 4 == 2, record("text_latn")).otherwise(F.concat(F.lit("{"), "n_name"))
    nations(spark, sf).select(line).write.text(path)
    return readers.set_lines(spark, path)


@query("SELECT r_name AS book, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS INTEGER) AS page, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def s28_book_pages(spark, sf):
    """A book for each region with a page for each nation, half of them with a text."""
    root = folder(spark, "books")
    numbers: dict[str, int] = {}
    stated: dict[str, list[str]] = {}
    for r in nations(spark, sf).collect():
        book = r["r_name"]
        numbers[book] = numbers.get(book, 0) + 1
        put(spark, f"{root}/{book}/crops/page_{numbers[book]:04d}.png", b"png")
        if r["n_nationkey"] % 2 == 0:
            stated.setdefault(book, []).append(f'{{"page_number": {numbers[book]}, "text": "{r["n_name"]}"}}')
    for book, lines in stated.items():
        put(spark, f"{root}/{book}/pages.jsonl", "\n".join([*lines, "{broken"]).encode())
    return readers.book_pages(spark, root).select("book", "page", "text")


@query("SELECT 'clip' || s_suppkey AS audio, s_name AS text, CAST(s_nationkey AS VARCHAR) AS speaker FROM supplier")
def s29_strict_filelist(spark, sf):
    path = folder(spark, "strict")
    sinks.filelist(table(spark, sf, "supplier").select(F.concat(F.lit("clip"), "s_suppkey").alias("audio"), F.col("s_name").alias("text"), F.col("s_nationkey").alias("speaker")), path)
    return readers.filelist(spark, path)


@query(
    """SELECT n_name AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'permissive' WHEN n_nationkey % 3 = 1 THEN 'share-alike' ELSE 'unclear' END AS redistribution,
    CAST(row_number() OVER (ORDER BY n_nationkey % 3, n_nationkey % 2, n_name) AS INTEGER) AS place FROM nation WHERE n_nationkey % 5 <> 4 ORDER BY 3"""
)
def s30_registry(spark, sf):
    """Catalogue entries are checked on the driver, then ranked as a table."""
    import datetime as dt

    licences = ("cc0-1.0", "ODbL", "own terms")
    entries = [
        {"id": r["n_name"], "name": r["n_name"], "modality": "speech" if r["n_nationkey"] % 5 == 4 else "text", "tier": ("core", "supplementary")[r["n_nationkey"] % 2], "access": "open", "uri": "u", "licence": licences[r["n_nationkey"] % 3], "languages": ["kab"], "size": {"rows": 1}, "retrieved": dt.date(2024, 1, 1)}
        for r in table(spark, sf, "nation").collect()
    ]
    ranked = registry.eligible(registry.load(spark, entries), [])
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("priority", F.when(F.col("tier") == "core", 0).otherwise(1), "id"))
    return ranked.select("id", "redistribution", place.alias("place"))


@query(
    """WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS path, max(o_orderdate) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), r AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderdate AS removed_at FROM orders WHERE o_orderstatus = 'P')
    SELECT r.path, CAST(count(*) AS BIGINT) AS standing FROM r LEFT JOIN f USING (path) WHERE last IS NULL OR last <= removed_at GROUP BY 1"""
)
def s31_manifest_log(spark, sf):
    """Two appends of fetches and one of removals; what was removed and not fetched again stands."""
    fetches, removals = folder(spark, "fetched"), folder(spark, "removed")
    orders = table(spark, sf, "orders")
    own = {"source_id": F.lit("s"), "path": F.col("o_custkey").cast("string"), "sha256": F.sha2(F.col("o_orderkey").cast("string"), 256)}
    landed = orders.select(*[c.alias(k) for k, c in own.items()], F.lit("text").alias("kind"), F.lit("local").alias("target"), F.lit(1).cast("long").alias("bytes"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), "o_orderstatus")
    for status in ("F", "O"):
        registry.record(landed.where(F.col("o_orderstatus") == status), fetches, registry.MANIFEST)
    gone = orders.where("o_orderstatus = 'P'").select(*[c.alias(k) for k, c in own.items()], F.lit("r").alias("reason"), F.col("o_orderdate").cast("timestamp").alias("removed_at"))
    registry.record(gone, removals, registry.REMOVAL)
    standing = registry.standing_removals(registry.recorded(spark, fetches, registry.MANIFEST), registry.recorded(spark, removals, registry.REMOVAL))
    return standing.groupBy("path").agg(F.count("*").alias("standing"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def k01_corpus_sink(spark, sf):
    """A second write replaces the first as a whole."""
    path = f"{folder(spark, 'corpus')}.jsonl"
    sinks.corpus(docs(spark, sf).limit(3).select("source", "text"), path)
    sinks.corpus(docs(spark, sf).select("source", "text"), path)
    return readers.json_lines(spark, path, "source string, text string").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT w AS form, upos FROM (SELECT w, CASE length(w) % 2 WHEN 0 THEN 'NOUN' ELSE 'VERB' END AS upos FROM (SELECT DISTINCT unnest(" + WORDS + ") AS w FROM documents))")
def k03_lexicon_sink(spark, sf):
    """Entries of two sources merge by priority and are written; each form stands once for its class."""
    path = folder(spark, "lexicon")
    words = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("form")).distinct()
    upos = F.when(F.char_length("form") % 2 == 0, "NOUN").otherwise("VERB")
    of = lambda source: words.select("form", F.col("form").alias("lemma"), upos.alias("upos"), F.create_map().cast("map<string,string>").alias("feats"), F.lit(source).alias("source"))
    sinks.lexicon(of("a").unionByName(of("b")), {"b": 0, "a": 1}, path)
    return spark.read.parquet(path).where("source = 'b'").select("form", "upos")


@query("SELECT CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS least FROM documents GROUP BY 1")
def k04_split_writer(spark, sf):
    path = folder(spark, "parts")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    sinks.splits(docs(spark, sf).select("doc_id", "text", split.alias("split")), path, ["train", "dev", "test"], key="doc_id")
    return spark.read.schema("doc_id long, text string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations) WHERE line <> ''")
def k09_plain_lines(spark, sf):
    path = f"{folder(spark, 'plain')}.txt"
    sinks.plain_text(table(spark, sf, "conversations"), "text", path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.char_length("value")).alias("chars"))
