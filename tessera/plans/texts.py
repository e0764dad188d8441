"""Text functions over the documents, pages and conversations: ratios, cleaning, scripts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import align, corrupt, labels, normalise, phonemes, script, segment, text
from tessera.plans import forms, whole
from tessera.plans.shared import LETTERS, ORTHOGRAPHY_SQL, TOKENS, TYPESET_SQL, WORDS, docs, in_orthography, pairs, pairs_sql, sql_list, squeezed, typeset
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


def T():
    """The text column; columns can only be made once there is a session."""
    return F.col("text")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 1000 AND lang = 'en'")
def s01_pushed_scan(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("n_chars > 1000 AND lang = 'en'").select("doc_id", "lang", "n_chars")


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE {LETTERS} / length(text) END, 6) AS ratio FROM documents")
def m01_letter_ratio(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.letter_ratio(T()), 6).alias("ratio"))


LATIN_OF = f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^\\x{{0000}}-\\x{{024F}}{text.MARKED}]', '', 'g'))"


@query(f"SELECT doc_id, round(CASE WHEN {LETTERS} = 0 THEN 0 ELSE {LATIN_OF} / {LETTERS} END, 6) AS ratio FROM documents")
def m02_latin_ratio(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.latin_ratio(T()), 6).alias("ratio"))


@query(f"SELECT doc_id, round(CASE WHEN {LETTERS} = 0 THEN 0 ELSE length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Latin}}]', '', 'g')) / {LETTERS} END, 6) AS ratio FROM documents")
def m03_latin_share(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.latin_share(T()), 6).alias("ratio"))


def rate_sql(words: list[str]) -> str:
    return f"CASE WHEN len({WORDS}) = 0 THEN 0 ELSE len(list_filter({WORDS}, lambda w: w IN {sql_list(words)})) / len({WORDS}) END"


MARKED_SQL = f"CASE WHEN {LETTERS} = 0 THEN 0 ELSE length(regexp_replace(text, '[^{text.MARKED}]', '', 'g')) / {LETTERS} END"


@query(f"SELECT doc_id, round({MARKED_SQL}, 6) AS marked, round({rate_sql(text.FUNCTION_WORDS)}, 6) AS closed FROM documents")
def m04_letter_and_word_rates(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.marked_rate(T()), 6).alias("marked"), F.round(text.word_rate(T(), text.FUNCTION_WORDS), 6).alias("closed"))


@query(
    f"""WITH s AS (SELECT lang, sum(length(regexp_replace(text, '[^{text.MARKED}]', '', 'g'))) / sum({LETTERS}) AS marked,
    sum(len(list_filter({WORDS}, lambda w: w IN {sql_list(text.FUNCTION_WORDS)}))) / sum(len({WORDS})) AS closed FROM documents GROUP BY lang)
    SELECT lang, round(CASE WHEN marked <= 0 THEN 0 ELSE 0.6 * least(marked / 0.08, 1) + 0.4 * least(closed / 0.30, 1) END, 6) AS score FROM s"""
)
def m05_pooled_language_score(spark, sf):
    """Counts are pooled over the column before they are blended."""
    pooled = docs(spark, sf).groupBy("lang").agg(
        (F.sum(F.regexp_count(T(), F.lit(f"[{text.MARKED}]"))) / F.sum(text.letters(T()))).alias("marked"),
        (F.sum(F.size(F.filter(text.words(T()), lambda w: w.isin(text.FUNCTION_WORDS)))) / F.sum(F.size(text.words(T())))).alias("closed"),
    )
    return pooled.select("lang", F.round(text.evidence(F.col("marked"), F.col("closed")), 6).alias("score"))


@query(f"SELECT doc_id, round({rate_sql(text.ENGLISH)}, 6) AS english, round({rate_sql(text.FRENCH)}, 6) AS french FROM documents")
def m06_word_rates(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.word_rate(T(), text.ENGLISH), 6).alias("english"), F.round(text.word_rate(T(), text.FRENCH), 6).alias("french"))


RATIO_SQL = "CASE WHEN least(length(left_text), length(right_text)) = 0 THEN 1.0 ELSE greatest(length(left_text), length(right_text)) / least(length(left_text), length(right_text)) END"


@query(f"SELECT conv_id, turn, round({RATIO_SQL}, 6) AS ratio FROM ({pairs_sql})")
def m07_length_ratio(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(text.length_ratio(F.col("left_text"), F.col("right_text")), 6).alias("ratio"))


NUMBERS_SQL = "list_sort(list_transform(regexp_extract_all({}, '\\d[\\d., ]*\\d|\\d'), lambda x: regexp_replace(translate(x, '., ', ''), '^0+([0-9])', '\\1')))"


@query(f"SELECT conv_id, turn, array_to_string({NUMBERS_SQL.format('left_text')}, ';') AS numbers, {NUMBERS_SQL.format('left_text')} = {NUMBERS_SQL.format('right_text')} AS agree FROM ({pairs_sql})")
def m08_number_multisets(spark, sf):
    own, other = text.numbers(F.col("left_text")), text.numbers(F.col("right_text"))
    return pairs(spark, sf).select("conv_id", "turn", F.array_join(own, ";").alias("numbers"), (own == other).alias("agree"))


@query(f"SELECT doc_id, round(len(list_filter(list_zip({TOKENS('text')}, {TOKENS('lower(text)')}), lambda z: z[1] <> z[2])) / greatest(1, len({TOKENS('text')})), 6) AS divergence FROM documents")
def m09_token_divergence(spark, sf):
    return docs(spark, sf).select("doc_id", F.round(text.token_divergence(T(), F.lower(T())), 6).alias("divergence"))


@query("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS edits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def m10_edit_distance(spark, sf):
    a, b = (table(spark, sf, "nation").select(*[F.col(c).alias(f"{p}_{c}") for c in ("n_nationkey", "n_name", "n_regionkey")]) for p in "ab")
    both = a.join(b, (F.col("a_n_regionkey") == F.col("b_n_regionkey")) & (F.col("a_n_nationkey") < F.col("b_n_nationkey")))
    return both.select(F.col("a_n_nationkey").alias("a_key"), F.col("b_n_nationkey").alias("b_key"), F.levenshtein("a_n_name", "b_n_name").alias("edits"))


ASCII_SQL = "regexp_replace({}, '[^\\x00-\\x7F]', '?', 'g')"
EDITED_SQL = "length(text) - length(replace(text, 'e', '')) + length(text) - length(replace(text, 'o', ''))"


def edited(column):
    """The text without one of its letters and with a sign for another, so that the edits can be counted in SQL."""
    return F.translate(F.replace(column, F.lit("e"), F.lit("")), "o", "\x01")


@query(f"SELECT doc_id, CAST({EDITED_SQL} AS BIGINT) AS edits FROM documents")
def m10_whole_distance(spark, sf):
    """Edits between each whole text and its edited form."""
    return docs(spark, sf).select("doc_id", align.edits(T(), edited(T())).alias("edits"))


@query(f"SELECT conv_id, turn, CAST(levenshtein({ASCII_SQL.format('left_text')}, {ASCII_SQL.format('right_text')}) AS BIGINT) AS edits FROM ({pairs_sql})")
def m10_turn_distance(spark, sf):
    """Edits between each question and its answer, characters beyond ASCII as one sign: the twin counts bytes."""
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    return pairs(spark, sf).select("conv_id", "turn", align.edits(ascii_("left_text"), ascii_("right_text")).alias("edits"))


@query("""SELECT lang, CAST(sum(length(text) - length(regexp_replace(text, '[eo]', '', 'g'))) AS BIGINT) AS edited, CAST(sum(length(regexp_replace(text, '[eo]', '', 'g'))) AS BIGINT) AS matched,
    CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS dropped, CAST(sum(length(text) - length(replace(text, 'o', ''))) AS BIGINT) AS replaced, CAST(0 AS BIGINT) AS added FROM documents GROUP BY lang""")
def m11_whole_alignment(spark, sf):
    """The aligned characters of each whole text and its edited form, counted by what became of them."""
    p = docs(spark, sf).select("lang", F.inline(align.tallied(T(), edited(T()))))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    ref, hyp = F.col("ref"), F.col("hyp")
    return p.groupBy("lang").agg(of(ref != hyp).alias("edited"), of(ref == hyp).alias("matched"), of(hyp == "").alias("dropped"), of((ref != hyp) & (ref != "") & (hyp != "")).alias("replaced"), of(ref == "").alias("added"))


@query(f"""WITH RECURSIVE {forms.aligned("SELECT a.n_name AS r, b.n_name AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")}
    SELECT r AS ref_name, h AS hyp_name, place, ref, hyp FROM pairs_""")
def m11_character_alignment(spark, sf):
    a = table(spark, sf, "nation").alias("a")
    b = table(spark, sf, "nation").alias("b")
    both = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    one = both.select(F.col("a.n_name").alias("ref_name"), F.col("b.n_name").alias("hyp_name"), F.posexplode(align.aligned(F.col("a.n_name"), F.col("b.n_name"))).alias("place", "p"))
    return one.select("ref_name", "hyp_name", "place", "p.ref", "p.hyp")


@query(
    """SELECT a.vec_id AS vec_id, round(CASE WHEN list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) = 0 THEN 0
    ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def m12_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("SELECT doc_id, replace(text, 'e', '') AS kept, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS n_removed FROM documents")
def m13_vowel_skeleton(spark, sf):
    found = docs(spark, sf).select("doc_id", script.skeleton(T()).alias("s"))
    return found.select("doc_id", "s.kept", F.size("s.places").cast("long").alias("n_removed"))


FRAMES_SQL = "n_chars * 16"
for _k, _s in ((10, 5), (3, 2), (3, 2), (3, 2), (3, 2), (2, 2), (2, 2)):
    FRAMES_SQL = f"(floor(({FRAMES_SQL} - {_k}) / {_s}) + 1)"


@query(f"SELECT doc_id, CAST({FRAMES_SQL} AS BIGINT) AS frames FROM documents")
def m14_encoder_frames(spark, sf):
    return docs(spark, sf).select("doc_id", text.frames(F.col("n_chars") * 16).alias("frames"))


@query("SELECT event_id, round(greatest(0, value - 0.05), 6) AS start_s, round(least(value + 0.1, 30), 6) AS end_s, round(least(power(10, (value - 20) / 20), 4.0), 6) AS gain FROM events")
def m15_bounds_and_gain(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        F.round(F.greatest(F.lit(0.0), v - 0.05), 6).alias("start_s"),
        F.round(F.least(v + 0.1, F.lit(30.0)), 6).alias("end_s"),
        F.round(F.least(F.pow(F.lit(10.0), (v - 20) / 20), F.lit(4.0)), 6).alias("gain"),
    )


@query("SELECT event_type, round(exp(sum(value) / 100 / count(*)), 6) AS perplexity, round(sum(value) / 100 / ln(2) / sum(length(props)), 6) AS bits_per_char FROM events GROUP BY event_type")
def m16_likelihood_figures(spark, sf):
    nll = F.sum("value") / 100
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.exp(nll / F.count("*")), 6).alias("perplexity"), F.round(nll / F.log(F.lit(2.0)) / F.sum(F.char_length("props")), 6).alias("bits_per_char")
    )


@query(f"SELECT w AS word, ipa, CAST({forms.sound_count('ipa')} AS INTEGER) AS sounds FROM (SELECT w, {forms.ipa('w')} AS ipa FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents))")
def m17_sound_count(spark, sf):
    words = docs(spark, sf).select(F.explode(text.words(T())).alias("word")).distinct()
    none = spark.createDataFrame([], "word string, ipa string")
    return phonemes.readings(words, none).select("word", "ipa", phonemes.sound_count(F.col("ipa")).alias("sounds"))


@query(f"SELECT doc_id, {forms.normal_form('text')} AS text FROM documents")
def x01_normalised(spark, sf):
    return docs(spark, sf).select("doc_id", normalise.normalised(T()).alias("text"))


@query(f"WITH {forms.FLAGS} SELECT kind, text, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS texts FROM flags WHERE kind IS NOT NULL GROUP BY ALL")
def x03_edit_report(spark, sf):
    found = docs(spark, sf).select("doc_id", normalise.reported(T()).alias("r"))
    return found.select("doc_id", F.explode("r.flags").alias("f")).groupBy("f.kind", "f.text").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


TIFINAGH_SQL = f"translate(replace(replace({{}}, 'č', 'ⵜⵛ'), 'ǧ', 'ⴷⵊ'), '{script.LATIN.replace('e', '')}{script.LATIN.replace('e', '').upper()}opvţOPVŢeE-', '{(script.TIFINAGH.replace('ⴻ', '')) * 2}ⵓⴱⴼⵜⵓⴱⴼⵜ')"


@query(f"SELECT doc_id, {TIFINAGH_SQL.format('text')} AS tifinagh FROM documents")
def x05_to_tifinagh(spark, sf):
    return docs(spark, sf).select("doc_id", script.to_tifinagh(T()).alias("tifinagh"))


BACK_SQL = f"translate(replace(replace({TIFINAGH_SQL.format('text')}, 'ⵜⵛ', 'č'), 'ⴷⵊ', 'ǧ'), '{script.TIFINAGH}ⵯ', '{script.LATIN}')"


@query(
    f"""SELECT lang, CAST(sum(length(lower(text)) - length(replace(lower(text), 'e', ''))) AS BIGINT) AS schwa_lost, CAST(sum(length(text) - length(replace(text, '-', ''))) AS BIGINT) AS hyphens_lost,
    CAST(count(*) FILTER (text = {BACK_SQL}) AS BIGINT) AS lossless FROM documents GROUP BY lang"""
)
def x05_round_trip(spark, sf):
    found = docs(spark, sf).select("lang", script.round_trip(T()).alias("r"))
    return found.groupBy("lang").agg(F.sum("r.schwa_lost").alias("schwa_lost"), F.sum("r.hyphens_lost").alias("hyphens_lost"), F.count_if("r.lossless").alias("lossless"))


@query(f"SELECT doc_id, translate(lower(text), '{script.LATIN}', '{script.TIFINAGH}') AS tifinagh FROM documents")
def x06_table_transliteration(spark, sf):
    return docs(spark, sf).select("doc_id", script.table_tifinagh(T()).alias("tifinagh"))


@query(f"SELECT md5(key) AS key, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM (SELECT doc_id, {forms.duplicate_key('text')} AS key FROM documents) GROUP BY 1 HAVING count(*) > 1")
def x07_duplicate_key(spark, sf):
    keyed = docs(spark, sf).select("doc_id", normalise.fingerprint(T()).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(f"""SELECT conv_id, turn, md5({forms.duplicate_key("(left_text || ' ' || right_text)")}) AS key FROM ({pairs_sql})""")
def x08_pair_key(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", normalise.pair_fingerprint(F.col("left_text"), F.col("right_text")).alias("key"))


@query(
    f"""SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' ')))) AS BIGINT) AS grams
    FROM (SELECT doc_id, {TOKENS('lower(text)')} AS t FROM documents)"""
)
def x09_ngram_sets(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(text.ngrams(T(), 8)).cast("long").alias("grams"))


@query(f"SELECT doc_id, {forms.collation_key('text')} AS key FROM documents")
def x11_collation_key(spark, sf):
    return docs(spark, sf).select("doc_id", normalise.on_texts(labels.collation_key)(T()).alias("key"))


@query(f"""WITH {forms.LABELLED} SELECT lang, mark, "case", CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY ALL""")
def x12_labelled_words(spark, sf):
    found = docs(spark, sf).select("lang", F.explode(labels.annotated(T())).alias("w"))
    return found.groupBy("lang", "w.mark", "w.case").agg(F.count("*").alias("n"))


@query(f"WITH {forms.LABELLED}, r AS (SELECT doc_id, string_agg({forms.RESTORED}, ' ' ORDER BY held, i) AS text FROM labelled GROUP BY doc_id) SELECT d.doc_id, coalesce(r.text, '') AS text FROM documents d LEFT JOIN r USING (doc_id)")
def x12_restored(spark, sf):
    return docs(spark, sf).select("doc_id", labels.restored(labels.annotated(T())).alias("text"))


@query(f"SELECT doc_id, {forms.spoken('text')} AS target FROM documents")
def x13_spoken_target(spark, sf):
    return docs(spark, sf).select("doc_id", normalise.on_texts(labels.spoken)(T()).alias("target"))


@query(f"SELECT doc_id, {whole.folded('x')} AS folded, CAST(length(regexp_replace(x, '[^{text.FOLD_FROM}]', '', 'g')) AS INTEGER) AS marks FROM (SELECT doc_id, {TYPESET_SQL.format('text')} AS x FROM documents)")
def x16_typography(spark, sf):
    """Documents set in type, folded, and how many marks of set type they had."""
    own = typeset(T())
    return docs(spark, sf).select("doc_id", text.fold_typography(own).alias("folded"), F.regexp_count(own, F.lit(f"[{text.FOLD_FROM}]")).alias("marks"))


@query()
def x17_shouted_lines(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.posexplode(F.split(T(), "\n")).alias("line", "text"))
    return lines.where(text.shouted(T())).select("doc_id", "line", text.soften(T()).alias("soft"))


@query(f"WITH documents AS (SELECT doc_id, {forms.SET_TO_70} AS text FROM documents), {forms.UNWRAPPED} SELECT d.doc_id, coalesce(g.text, d.text) AS text FROM documents d LEFT JOIN glued g USING (doc_id)")
def x18_unwrapped(spark, sf):
    """Over the documents as if set to 70 columns."""
    wrapped = F.regexp_replace(T(), r"([^\n]{1,70})[ ]+", "$1\n")
    return docs(spark, sf).select("doc_id", normalise.on_texts(segment.unwrap)(wrapped).alias("text"))


@query()
def x19_units(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(segment.segmented(T())).alias("place", "u")).select("doc_id", "place", "u.text", "u.prefix", "u.suffix")


@query(f"WITH {forms.UNWRAPPED} SELECT d.doc_id, coalesce(g.text, d.text) AS text FROM documents d LEFT JOIN glued g USING (doc_id)")
def x20_reassembled(spark, sf):
    return docs(spark, sf).select("doc_id", segment.assembled(segment.segmented(T())).alias("text"))


SENTENCES_SQL = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: {squeezed('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({SENTENCES_SQL}) AS BIGINT) AS sentences, {SENTENCES_SQL}[1] AS head FROM documents")
def x21_sentence_split(spark, sf):
    own = text.sentences(T())
    return docs(spark, sf).select("doc_id", F.size(own).cast("long").alias("sentences"), F.get(own, 0).alias("head"))


@query(f"SELECT doc_id, {forms.WIKITEXT} AS plain FROM documents")
def x22_wikitext(spark, sf):
    return docs(spark, sf).select("doc_id", text.strip_wikitext(T()).alias("plain"))


@query(f"SELECT page_id, {squeezed(chr(34) + 'stripped' + chr(34))} AS plain FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS stripped FROM pages)")
def x23_html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(f"SELECT word, n, {forms.affricates('ipa')} AS ipa FROM (SELECT word, CAST(count(*) AS BIGINT) AS n, {forms.ipa('word')} AS ipa FROM (SELECT unnest({forms.spoken_words('text')}) AS word FROM documents) GROUP BY word)")
def x14_phonemes(spark, sf):
    words = docs(spark, sf).select(F.explode(phonemes.spoken_words(T())).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    none = spark.createDataFrame([], "word string, ipa string")
    return phonemes.readings(words, none).select("word", "n", phonemes.fold_affricates(F.col("ipa")).alias("ipa"))


FREE_SQL = ", ".join(f"CASE WHEN starts_with(w, '{p}') AND length(w) > {len(p)} THEN '{f}' || substr(w, {len(p) + 1}) END" for p, fs in text.ANNEXED for f in fs)


@query(
    f"""WITH w AS (SELECT DISTINCT unnest({WORDS}) AS w FROM documents),
    c AS (SELECT w, unnest([{FREE_SQL}]) AS free FROM w) SELECT DISTINCT w AS word, free FROM c WHERE free IS NOT NULL AND free <> w"""
)
def x25_free_candidates(spark, sf):
    words = docs(spark, sf).select(F.explode(text.words(T())).alias("word")).distinct()
    return words.select("word", F.explode(text.free_candidates(F.col("word"))).alias("free"))


@query(f"WITH w AS (SELECT DISTINCT unnest({TOKENS('text')}) AS w FROM documents) SELECT w AS word, split_part(w, '-', 1) AS head FROM w WHERE contains(w, '-') AND length(split_part(w, '-', 1)) >= 2")
def x26_clitic_head(spark, sf):
    words = docs(spark, sf).select(F.explode(text.tokens(T())).alias("word")).distinct()
    return words.select("word", text.clitic_head(F.col("word")).alias("head")).where("head IS NOT NULL")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '_' ELSE 'Priority=' || o_orderpriority || '|Status=' || o_orderstatus END AS feats FROM orders")
def x27_feature_string(spark, sf):
    feats = F.when(F.col("o_orderstatus") == "F", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("Status"), "o_orderstatus", F.lit("Priority"), "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", text.feature_string(feats).alias("feats"))


@query(f"SELECT doc_id, translate({ORTHOGRAPHY_SQL.format('text')}, 'ɛɣƐƔ', 'εγΣΓ') AS corrupted FROM documents")
def x28_homoglyph_corruption(spark, sf):
    return docs(spark, sf).select("doc_id", corrupt.lookalike(in_orthography(T())).alias("corrupted"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<a>' || left_text || '<b>' || right_text ELSE '<b>' || right_text || '<a>' || left_text END AS document FROM ({pairs_sql})")
def x30_aligned_document(spark, sf):
    a, b = F.concat(F.lit("<a>"), "left_text"), F.concat(F.lit("<b>"), "right_text")
    return pairs(spark, sf).select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(a, b)).otherwise(F.concat(b, a)).alias("document"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(list_filter(string_split(right_text, chr(10)), lambda x: trim(x) <> '')[1], '^\\w+:\\s*', '')) AS reply FROM ({pairs_sql})")
def x31_reply_shaping(spark, sf):
    first = F.get(F.filter(F.split("right_text", "\n"), lambda x: F.trim(x) != ""), 0)
    return pairs(spark, sf).select("conv_id", "turn", F.trim(F.regexp_replace(first, r"^\w+:\s*", "")).alias("reply"))


GATES = "NOT regexp_matches(x, '\\{\\{|\\}\\}|\\[\\[|\\]\\]|\\||https?://')"


@query(
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS x FROM documents)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS usable FROM s WHERE {GATES} AND len({TOKENS('x')}) BETWEEN 5 AND 120
    AND length(regexp_replace(regexp_replace(x, '[^\\p{{L}}]', '', 'g'), '[^\\p{{Latin}}]', '', 'g')) >= 0.8 * length(regexp_replace(x, '[^\\p{{L}}]', '', 'g'))
    AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) > 0 GROUP BY doc_id"""
)
def f04_usable_lines(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(text.sentences(T())).alias("x"))
    return lines.where(text.usable_line(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("usable"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS x FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS wellformed FROM s
    WHERE length(x) >= 12 AND len({TOKENS('x')}) BETWEEN 3 AND 60 AND regexp_matches(x, '^\\p{{Lu}}') AND regexp_matches(x, '[.?!]$')
    AND NOT regexp_matches(x, '%[0-9$sdfl]|\\{{\\d|</?[a-z]+>|\\[[^\\]]*\\]|https?://|_{{2,}}') AND length(regexp_replace(x, '[^\\p{{Nd}}]', '', 'g')) <= length(x) * 0.15 GROUP BY doc_id"""
)
def f05_wellformed(spark, sf):
    lines = docs(spark, sf).select("doc_id", F.explode(text.sentences(T())).alias("x"))
    return lines.where(text.wellformed(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("wellformed"))


@query(f"SELECT conv_id, turn FROM ({pairs_sql}) WHERE length(left_text) >= 12 AND length(right_text) >= 12 AND contains(left_text, ' ') AND contains(right_text, ' ') AND NOT regexp_matches(left_text || right_text, '\\{{[^{{}}]*\\}}|%[sd]')")
def f06_pivot_usable(spark, sf):
    sides = F.array("left_text", "right_text")
    good = F.forall(sides, lambda s: (F.char_length(s) >= 12) & s.contains(" ") & ~s.rlike(r"\{[^{}]*\}|%[sd]"))
    return pairs(spark, sf).where(good).select("conv_id", "turn")


@query(f"""SELECT conv_id, turn, {forms.FAILED} AS failed FROM (SELECT *, {TOKENS('left_text')} AS lt, {TOKENS('right_text')} AS rt, regexp_extract_all(lower(left_text), '\\p{{L}}+') AS lw, regexp_extract_all(lower(right_text), '\\p{{L}}+') AS rw FROM ({pairs_sql}))""")
def f07_failed_translation(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", text.failed_translation(F.col("left_text"), F.col("right_text")).alias("failed"))


@query("SELECT doc_id, source FROM documents WHERE NOT contains(lower(source), '7')")
def f08_marked_sources(spark, sf):
    return docs(spark, sf).where(~F.lower("source").contains("7")).select("doc_id", "source")


@query("SELECT doc_id, CAST('0x' || substr(sha256('holdout' || text), 1, 15) AS BIGINT) % 100 = 0 AS held_out FROM documents")
def f09_held_out(spark, sf):
    return docs(spark, sf).select("doc_id", text.held_out(T()).alias("held_out"))


@query("SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 AS validation FROM documents")
def f10_validation_split(spark, sf):
    return docs(spark, sf).select("doc_id", text.validation(T(), 0.05).alias("validation"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 40 AND 1000")
def f11_eligible_length(spark, sf):
    return docs(spark, sf).where(F.char_length("text").between(40, 1000)).select("doc_id")


@query("SELECT CASE WHEN ms < 400 THEN 'too-short' WHEN ms > 20000 THEN 'too-long' WHEN n_chars > ms / 20 THEN 'longer-than-frames' ELSE 'kept' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT n_chars, n_chars * (10 + doc_id % 30) AS ms FROM documents) GROUP BY 1")
def f12_clip_verdicts(spark, sf):
    ms = F.col("n_chars") * (10 + F.col("doc_id") % 30)
    verdict = F.when(ms < 400, "too-short").when(ms > 20_000, "too-long").when(F.col("n_chars") > ms / 20, "longer-than-frames").otherwise("kept")
    return docs(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\p{L}')")
def f15_translatable(spark, sf):
    return table(spark, sf, "conversations").where(T().rlike(r"\p{L}")).select("conv_id", "turn")


CLASS_SQL = """CASE WHEN NOT regexp_matches(w, '\\p{L}') THEN 'no-letters' WHEN regexp_matches(w, '\\p{Nd}') THEN 'contains-digit' WHEN NOT regexp_matches(w, '\\p{Latin}') THEN 'other-script'
WHEN length(regexp_replace(w, '[^\\p{L}]', '', 'g')) = length(regexp_replace(w, '[^a-zA-ZčḍɛǧɣḥṛṣṭẓČḌƐǦƔḤṚṢṬẒ]', '', 'g')) THEN 'own-alphabet' ELSE 'foreign-latin' END"""


@query(f"WITH w AS (SELECT unnest({TOKENS('text')}) AS w FROM documents) SELECT {CLASS_SQL} AS class, CAST(count(*) AS BIGINT) AS tokens, CAST(count(DISTINCT w) AS BIGINT) AS types FROM w GROUP BY 1")
def f17_word_classes(spark, sf):
    counts = docs(spark, sf).select(F.explode(text.tokens(T())).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.groupBy(word_class(F.col("w")).alias("class")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


def word_class(w):
    own = F.regexp_count(w, F.lit("[a-zA-ZčḍɛǧɣḥṛṣṭẓČḌƐǦƔḤṚṢṬẒ]"))
    return F.when(~w.rlike(r"\p{L}"), "no-letters").when(w.rlike(r"\p{Nd}"), "contains-digit").when(~w.rlike(r"\p{IsLatin}"), "other-script").when(text.letters(w) == own, "own-alphabet").otherwise("foreign-latin")


@query("SELECT CASE WHEN regexp_matches(text, '[0-9@]') THEN 'unmapped' WHEN length(text) > 510 THEN 'too-long' ELSE 'kept' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def f18_recipe_rows(spark, sf):
    verdict = F.when(T().rlike("[0-9@]"), "unmapped").when(F.char_length("text") > 510, "too-long").otherwise("kept")
    return docs(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
