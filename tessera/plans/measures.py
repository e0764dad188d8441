"""Aggregations: pipeline counters, confusion scores, error rates, vocabularies, coverage, consistency, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import align, corrupt, labels, normalise, text
from tessera.functions.normalise import on_texts
from tessera.operators import dedup, leaks, retrieval, scores, splits
from tessera.plans.relations import KEY_SQL, LEXICON_SQL, keyed, lexicon
from tessera.plans import forms, whole
from tessera.plans.shared import ORTHOGRAPHY_SQL, TOKENS, WORDS, docs, in_orthography, pairs, pairs_sql
from tessera.plans.texts import CLASS_SQL, word_class
from tessera.session import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    """SELECT source, CAST(count(*) AS BIGINT) AS read, CAST(count(*) FILTER (n_chars BETWEEN 3 AND 2000) AS BIGINT) AS kept, CAST(count(*) FILTER (n_chars > 2000) AS BIGINT) AS too_long
    FROM documents GROUP BY ROLLUP (source)"""
)
def a01_pipeline_counters(spark, sf):
    """Counters per source and in total from one rollup; read = kept + all reasons."""
    n = F.col("n_chars")
    return docs(spark, sf).rollup("source").agg(F.count("*").alias("read"), F.count_if(n.between(3, 2000)).alias("kept"), F.count_if(n > 2000).alias("too_long"))


DEFECTS_SQL = f"""CASE WHEN trim(left_text) = '' OR trim(right_text) = '' THEN ['empty'] ELSE list_filter([
    CASE WHEN length(left_text) < 2 OR length(right_text) < 2 THEN 'too-short' END,
    CASE WHEN length(left_text) > 1000 OR length(right_text) > 1000 THEN 'too-long' END,
    CASE WHEN lower(trim(left_text)) = lower(trim(right_text)) THEN 'untranslated-copy' END,
    CASE WHEN least(len({TOKENS('left_text')}), len({TOKENS('right_text')})) >= 3 AND greatest(length(left_text), length(right_text)) / least(length(left_text), length(right_text)) > 4 THEN 'length-ratio' END], lambda x: x IS NOT NULL) END"""


def pieces_at(word, k: int):
    """All substrings of k characters, in order; none of a shorter word."""
    last = F.char_length(word) - k + 1
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(k)))
    return F.when(last >= 1, all_).otherwise(F.array().cast("array<string>"))


def labelled(spark, sf):
    """The labels that both engines state alike; f03 has all nine."""
    shown = ["empty", "too-short", "too-long", "untranslated-copy", "length-ratio"]
    found = text.pair_defects(F.col("left_text"), F.col("right_text"), "other")
    return pairs(spark, sf).select("conv_id", "turn", F.filter(found, lambda d: d.isin(shown)).alias("defects"))


@query(f"SELECT conv_id, turn, array_to_string({DEFECTS_SQL}, ',') AS defects FROM ({pairs_sql})")
def f03_shared_defects(spark, sf):
    return labelled(spark, sf).select("conv_id", "turn", F.array_join("defects", ",").alias("defects"))


@query()
def f03_pair_defects(spark, sf):
    found = text.pair_defects(F.col("left_text"), F.col("right_text"), "eng")
    return pairs(spark, sf).select("conv_id", "turn", found.alias("defects"), F.arrays_overlap(found, F.array(*map(F.lit, text.HARD_DEFECTS))).alias("hard"))


@query(f"SELECT defect, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({DEFECTS_SQL}) AS defect FROM ({pairs_sql})) GROUP BY defect")
def a02_defect_histogram(spark, sf):
    return labelled(spark, sf).select(F.explode("defects").alias("defect")).groupBy("defect").agg(F.count("*").alias("n"))


@query(
    """SELECT r_name AS stratum, CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS hard, round(count(*) FILTER (c_acctbal < 0) / count(*), 6) AS rate
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def a03_strata(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bad = F.count_if(F.col("c_acctbal") < 0)
    return c.groupBy(F.col("r_name").alias("stratum")).agg(F.count("*").alias("pairs"), bad.alias("hard"), F.round(bad / F.count("*"), 6).alias("rate"))


@query(f"""WITH f AS (SELECT lang, text, {forms.normal_form('text')} AS fixed FROM documents), d AS (SELECT *, {TOKENS('text')} AS a, {TOKENS('fixed')} AS b FROM f)
    SELECT lang, CAST(count(*) AS BIGINT) AS texts, CAST(count(*) FILTER (fixed <> text) AS BIGINT) AS changed,
    round(avg((greatest(len(a), len(b)) - len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]))) / greatest(len(a), len(b))) FILTER (fixed <> text), 6) AS divergence FROM d GROUP BY lang""")
def a04_orthography_audit(spark, sf):
    """Changed share, and the divergence over changed texts only."""
    own = docs(spark, sf).withColumn("fixed", normalise.normalised(F.col("text")))
    changed = F.col("fixed") != F.col("text")
    return own.groupBy("lang").agg(
        F.count("*").alias("texts"), F.count_if(changed).alias("changed"), F.round(F.avg(F.when(changed, text.token_divergence(F.col("text"), F.col("fixed")))), 6).alias("divergence")
    )


@query(f"""WITH documents AS (SELECT doc_id, translate({ORTHOGRAPHY_SQL.format('text')}, 'ɛɣƐƔ', 'εγΣΓ') AS text FROM documents), pieces AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(text), '[^{forms.SPACE}]+|[{forms.SPACE}]+')) AS p FROM documents),
    chars AS (SELECT doc_id, {forms.GUARD} AS guarded, unnest(string_split(p, '')) AS c FROM pieces), k AS ({forms.CHANGES.format(key="doc_id, guarded")})
    SELECT kind, c AS before, CAST(count(*) AS BIGINT) AS n FROM k WHERE kind <> 'homoglyph' OR NOT guarded GROUP BY ALL""")
def a04_changes_by_kind(spark, sf):
    """Of the documents as typed with the letters of another keyboard."""
    typed = corrupt.lookalike(in_orthography(F.col("text")))
    changes = docs(spark, sf).select(F.explode(normalise.reported(typed)["changes"]).alias("c"))
    return changes.groupBy("c.kind", "c.before").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT source, text, {forms.normal_form('text')} AS once FROM documents) SELECT source, CAST(count(*) FILTER (once <> text) AS BIGINT) AS changed, CAST(count(*) FILTER (once <> {forms.normal_form('once')}) AS BIGINT) AS not_idempotent FROM o GROUP BY source""")
def a35_normaliser_impact(spark, sf):
    """Changed share and violations of idempotence per source."""
    once = docs(spark, sf).withColumn("once", normalise.normalised(F.col("text")))
    return once.withColumn("twice", normalise.normalised(F.col("once"))).groupBy("source").agg(F.count_if(F.col("once") != F.col("text")).alias("changed"), F.count_if(F.col("once") != F.col("twice")).alias("not_idempotent"))


RULE_SQL = f"""CASE WHEN regexp_matches(text, '[ß]| (der|die|und) ') THEN 'de' WHEN regexp_matches(text, ' (le|la|les|des|une) ') THEN 'fr' WHEN regexp_matches(text, '[ñó]| (el|los|las|por) ') THEN 'es' ELSE 'en' END"""
CONFUSION_SQL = f"c AS (SELECT lang AS gold, {RULE_SQL} AS pred, count(*) AS n FROM documents GROUP BY ALL)"


def confusion(spark, sf):
    """Languages against a rule of marker words: a predictor that both engines can state."""
    t = F.col("text")
    rule = F.when(t.rlike("[ß]| (der|die|und) "), "de").when(t.rlike(" (le|la|les|des|une) "), "fr").when(t.rlike("[ñó]| (el|los|las|por) "), "es").otherwise("en")
    return scores.confusion(docs(spark, sf).select(F.col("lang").alias("gold"), rule.alias("pred")))


@query(f"WITH {CONFUSION_SQL} SELECT gold, pred, CAST(n AS BIGINT) AS n FROM c")
def a06_confusion_matrix(spark, sf):
    return confusion(spark, sf)


SCORES_SQL = f"""{CONFUSION_SQL}, t AS (SELECT gold AS label, sum(n) AS support, sum(n) FILTER (gold = pred) AS hits FROM c GROUP BY 1), p AS (SELECT pred AS label, sum(n) AS predicted FROM c GROUP BY 1),
    s AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM t FULL OUTER JOIN p USING (label)),
    f AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM s),
    g AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f)"""


@query(f"WITH {SCORES_SQL} SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g")
def a07_class_scores(spark, sf):
    found = scores.class_scores(confusion(spark, sf))
    return found.select("label", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SCORES_SQL} SELECT round(sum(hits) / (SELECT sum(n) FROM c), 6) AS accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1 FROM g")
def a08_accuracy_and_macro_f1(spark, sf):
    return scores.summary(confusion(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(
    """WITH c AS (SELECT quality AS gold, CAST(n_chars > 600 AS INTEGER) AS pred FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT l, count(*) FILTER (gold = l AND pred = l) AS tp, count(*) FILTER (gold <> l AND pred = l) AS fp, count(*) FILTER (gold = l AND pred <> l) AS fn FROM c, (VALUES (0), (1)) v(l) GROUP BY l)
    SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM k"""
)
def a09_macro_f1_all_classes(spark, sf):
    rows = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    counts = scores.confusion(rows.select(F.col("quality").cast("string").alias("gold"), (F.col("n_chars") > 600).cast("int").cast("string").alias("pred")))
    return scores.summary(counts, ["0", "1"]).select(F.round("macro_f1", 6).alias("macro_f1"))


NAMES_SQL = "SELECT p_name AS ref, lower(p_brand) || substr(p_name, 6) AS hyp FROM part"


def name_pairs(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("ref"), F.concat(F.lower("p_brand"), F.substring("p_name", 6, 1_000)).alias("hyp"))


@query(f"SELECT round(avg(CAST(ref = hyp AS INTEGER)), 6) AS exact, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS cer FROM ({NAMES_SQL})")
def a10_string_scores(spark, sf):
    rows = name_pairs(spark, sf)
    return rows.agg(F.round(F.avg((F.col("ref") == F.col("hyp")).cast("int")), 6).alias("exact"), F.round(scores.error_rate(F.levenshtein("ref", "hyp"), F.char_length("ref")), 6).alias("cer"))


@query()
def a11_word_error_rate(spark, sf):
    rows = pairs(spark, sf).withColumns({"l": on_texts(labels.spoken)(F.col("left_text")), "r": on_texts(labels.spoken)(F.col("right_text"))})
    edits = align.word_distance(F.col("l"), F.col("r"))
    return rows.select("conv_id", edits.alias("edits"), F.size(text.tokens(F.col("l"))).alias("words")).agg(F.round(F.sum("edits") / F.sum("words"), 6).alias("wer"))


@query(f"""WITH RECURSIVE {forms.aligned(f"SELECT ref AS r, hyp AS h FROM ({NAMES_SQL})")}, m AS (SELECT ref IN ('a', 'e', 'i', 'o', 'u') AS r, hyp IN ('a', 'e', 'i', 'o', 'u') AS h, ref = hyp AS same, n FROM (SELECT p.*, n FROM pairs_ p JOIN (SELECT ref AS r, hyp AS h, count(*) AS n FROM ({NAMES_SQL}) GROUP BY ALL) USING (r, h))),
    c AS (SELECT CAST(sum(n) FILTER (r AND same) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (h AND NOT same), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (r AND NOT same), 0) AS BIGINT) AS fn FROM m) SELECT tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def a12_mark_f1(spark, sf):
    """Positional hits of marked letters on the character alignment of the names."""
    pairs_ = name_pairs(spark, sf).select(F.explode(align.aligned(F.col("ref"), F.col("hyp"))).alias("p"))
    marked = lambda c: F.coalesce(c.rlike("^[aeiou]$"), F.lit(False))
    r, h, same = marked(F.col("p.ref")), marked(F.col("p.hyp")), F.col("p.ref") == F.col("p.hyp")
    counted = pairs_.agg(F.count_if(r & same).alias("tp"), F.count_if(h & ~same).alias("fp"), F.count_if(r & ~same).alias("fn"))
    return counted.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query(
    """WITH a AS (SELECT l_suppkey AS k, l_linenumber AS place, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS k, l_linenumber AS place, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS hits, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS reference, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS predicted FROM a FULL OUTER JOIN b USING (k, place)"""
)
def a13_multiset_overlap(spark, sf):
    """Repeats at one place count: overlap is the least of both counts."""
    side = lambda flag, name: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("place")).agg(F.count("*").alias(name))
    both = side("A", "a").join(side("R", "b"), ["k", "place"], "full_outer").na.fill(0, ["a", "b"])
    return both.agg(F.sum(F.least("a", "b")).alias("hits"), F.sum("a").alias("reference"), F.sum("b").alias("predicted"))




@query(
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY ref, hyp) AS id, ref, hyp FROM (SELECT DISTINCT ref, hyp FROM ({NAMES_SQL}))),
    r AS (SELECT id, k, g, count(*) AS c FROM (SELECT id, k, unnest(list_transform(range(1, length(replace(ref, ' ', '')) - k + 2), lambda i: substr(replace(ref, ' ', ''), i, k))) AS g FROM p, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
    h AS (SELECT id, k, g, count(*) AS c FROM (SELECT id, k, unnest(list_transform(range(1, length(replace(hyp, ' ', '')) - k + 2), lambda i: substr(replace(hyp, ' ', ''), i, k))) AS g FROM p, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL),
    s AS (SELECT k, sum(least(coalesce(r.c, 0), coalesce(h.c, 0))) AS m, sum(coalesce(r.c, 0)) AS nr, sum(coalesce(h.c, 0)) AS nh FROM r FULL OUTER JOIN h USING (id, k, g) GROUP BY k)
    SELECT round(5 * avg(m / nh) * avg(m / nr) / (4 * avg(m / nh) + avg(m / nr)), 6) AS chrf FROM s"""
)
def a14_character_fscore(spark, sf):
    """Character n-gram F-score (orders 1 to 3, recall twice the weight) from corpus counts."""
    rows = name_pairs(spark, sf).distinct()

    def grams(column: str, name: str):
        plain = F.replace(F.col(column), F.lit(" "), F.lit(""))
        orders = [F.transform(pieces_at(plain, k), lambda g: F.struct(F.lit(k).alias("k"), g.alias("g"))) for k in (1, 2, 3)]  # noqa: B023
        return rows.select("ref", "hyp", F.inline(F.concat(*orders))).groupBy("ref", "hyp", "k", "g").agg(F.count("*").alias(name))

    both = grams("ref", "r").join(grams("hyp", "h"), ["ref", "hyp", "k", "g"], "full_outer").na.fill(0, ["r", "h"])
    shared = F.sum(F.least("r", "h"))
    sums = both.groupBy("k").agg(F.try_divide(shared, F.sum("h")).alias("p"), F.try_divide(shared, F.sum("r")).alias("q"))
    p, q = F.avg("p"), F.avg("q")
    return sums.agg(F.round(5 * p * q / (4 * p + q), 6).alias("chrf"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def a15_pearson(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(scores.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("pearson"))


@query(
    """WITH r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2 AS a,
    rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2 AS b FROM customer)
    SELECT c_nationkey, round(coalesce(corr(a, b), 0), 6) AS spearman FROM r GROUP BY c_nationkey HAVING count(*) > 3"""
)
def a15_spearman(spark, sf):
    ranked = scores.average_ranks(table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment"), ["c_nationkey"], "c_acctbal", "c_mktsegment")
    c = ranked.select("c_nationkey", F.col("c_acctbal_rank").alias("a"), F.col("c_mktsegment_rank").alias("b"))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.coalesce(scores.correlation(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("spearman")).where("n > 3").drop("n")


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
    SELECT round(corr(a, b), 6) AS spearman FROM r"""
)
def a15_spearman_of_all(spark, sf):
    """Over one group of all rows, one column with 50 values and one with many."""
    ranked = scores.average_ranks(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), [], "l_quantity", "l_extendedprice")
    return ranked.agg(F.round(scores.correlation(F.col("l_quantity_rank"), F.col("l_extendedprice_rank")), 6).alias("spearman"))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5('iso:' || vec_id), vec_id LIMIT 60)
    SELECT round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS spread, round(min(c), 5) AS low, round(max(c), 5) AS high, avg(c) > 0.5 OR stddev_pop(c) < 0.08 AS collapsed
    FROM (SELECT list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id < b.vec_id)"""
)
def a16_isotropy(spark, sf):
    """Pairs of a drawn sample of fixed size: the sample bounds the pairs."""
    e = splits.sample(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", 60, "iso")
    a, b = (e.select(F.col("vec_id").alias(f"{p}_id"), F.col("embedding").alias(f"{p}_v")) for p in "ab")
    c = a.join(F.broadcast(b), F.col("a_id") < F.col("b_id")).select(text.cosine(F.col("a_v"), F.col("b_v")).alias("c"))
    m, s = F.avg("c"), F.stddev_pop("c")
    return c.agg(F.round(m, 5).alias("mean"), F.round(s, 5).alias("spread"), F.round(F.min("c"), 5).alias("low"), F.round(F.max("c"), 5).alias("high"), ((m > 0.5) | (s < 0.08)).alias("collapsed"))


@query(
    f"""WITH x AS ({LEXICON_SQL}), t AS (SELECT source, unnest({WORDS}) AS w FROM documents)
    SELECT source, round(avg(CAST(form IS NOT NULL AS INTEGER)), 6) AS token_coverage, round(count(DISTINCT form) / count(DISTINCT w), 6) AS type_coverage FROM t LEFT JOIN x ON form = w GROUP BY source"""
)
def a17_lexicon_coverage(spark, sf):
    """Types are counted first, so each source and word is one row when the lexicon is joined."""
    counts = docs(spark, sf).select("source", F.explode(text.words(F.col("text"))).alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    known = counts.join(lexicon(spark, sf).select(F.col("form").alias("w"), F.lit(1).alias("known")), "w", "left")
    hit = F.when(F.col("known") == 1, F.col("n")).otherwise(0)
    return known.groupBy("source").agg(F.round(F.sum(hit) / F.sum("n"), 6).alias("token_coverage"), F.round(F.count("known") / F.count("*"), 6).alias("type_coverage"))


@query(f"WITH x AS ({LEXICON_SQL}), g AS (SELECT w, CASE length(w) % 2 WHEN 0 THEN 'NOUN' ELSE 'VERB' END AS gold FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)) SELECT round(count(upos) / count(*), 6) AS coverage, round(avg(CAST(upos = gold AS INTEGER)), 6) AS accuracy FROM g LEFT JOIN x ON form = w")
def a18_lexicon_against_gold(spark, sf):
    gold = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("form")).distinct().withColumn("gold", F.when(F.char_length("form") % 2 == 0, "NOUN").otherwise("VERB"))
    joined = gold.join(lexicon(spark, sf), "form", "left")
    return joined.agg(F.round(F.count("upos") / F.count("*"), 6).alias("coverage"), F.round(F.avg((F.col("upos") == F.col("gold")).cast("int")), 6).alias("accuracy"))


@query(f"SELECT upos, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT form) AS BIGINT) AS forms, CAST(count(*) FILTER (length(form) > 8) AS BIGINT) AS long_forms FROM ({LEXICON_SQL}) GROUP BY upos")
def a19_lexicon_summary(spark, sf):
    return lexicon(spark, sf).groupBy("upos").agg(F.count("*").alias("entries"), F.countDistinct("form").alias("forms"), F.count_if(F.char_length("form") > 8).alias("long_forms"))


@query(f"SELECT w AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({TOKENS('text')}) AS w FROM documents) GROUP BY w")
def a20_word_frequencies(spark, sf):
    return docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(whole.ORACLES["a21_whole_substring_counts"])
def a21_substring_counts(spark, sf):
    """Pieces of 1 to 16 characters of all words, with the word start."""
    return whole.a21_whole_substring_counts(spark, sf)


@query("SELECT c AS character, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM (SELECT source, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def a22_character_census(spark, sf):
    chars = docs(spark, sf).select("source", F.explode(F.split("text", "")).alias("character")).where("character <> ''")
    return chars.groupBy("source", "character").agg(F.count("*").alias("k")).groupBy("character").agg(F.sum("k").alias("n"), F.count("*").alias("sources"))


@query(f"SELECT c AS character, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split({forms.spoken('text')}, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def a23_spoken_vocabulary(spark, sf):
    target = on_texts(labels.spoken)(F.col("text"))
    chars = docs(spark, sf).select(F.explode(F.split(target, "")).alias("character")).where("character <> ''")
    return chars.groupBy("character").agg(F.count("*").alias("n"))


@query(f"SELECT lang, round(sum(length(text)) / sum(len({TOKENS('text')})), 6) AS chars_per_word FROM documents GROUP BY lang")
def a24_fertility(spark, sf):
    """Units per word with characters as units; an encoder is passed in as a column in the same place."""
    return docs(spark, sf).groupBy("lang").agg(F.round(F.sum(F.char_length("text")) / F.sum(F.size(text.tokens(F.col("text")))), 6).alias("chars_per_word"))


@query(f"SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(len({TOKENS('text')})) AS BIGINT) AS tokens, CAST(count(*) FILTER (CAST('0x' || substr(sha256('holdout' || text), 1, 15) AS BIGINT) % 100 = 0) AS BIGINT) AS held_out FROM documents GROUP BY source")
def a25_mixture_tallies(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size(text.tokens(F.col("text")))).cast("long").alias("tokens"), F.count_if(text.held_out(F.col("text"))).alias("held_out"))


@query(
    f"""WITH k AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY {KEY_SQL.format('text')} ORDER BY doc_id) AS first FROM documents WHERE n_chars BETWEEN 40 AND 1000),
    c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM k WHERE first = 1)
    SELECT source, lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM c WHERE rn <= 20 GROUP BY ALL"""
)
def a26_holdout_tallies(spark, sf):
    first = dedup.first_copies(keyed(docs(spark, sf).where("n_chars BETWEEN 40 AND 1000")), ["key"], ["doc_id"])
    capped = dedup.first_per_group(first, ["source", "lang"], ["doc_id"], 20)
    return capped.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


@query(
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS seg, list_distinct(regexp_extract_all(lower(left_text), '\\p{{L}}+')) AS a, list_distinct(regexp_extract_all(lower(right_text), '\\p{{L}}+')) AS b FROM ({pairs_sql})),
    s AS (SELECT seg, unnest(a) AS w FROM p), t AS (SELECT seg, unnest(b) AS w FROM p),
    sn AS (SELECT w, count(*) AS n FROM s WHERE length(w) >= 4 GROUP BY w HAVING count(*) >= 3 AND count(*) <= greatest(1, floor(0.15 * (SELECT count(*) FROM p)))), tn AS (SELECT w, count(*) AS n FROM t WHERE length(w) >= 4 GROUP BY w),
    j AS (SELECT s.w AS term, t.w AS cand, count(*) AS shared FROM s JOIN sn ON s.w = sn.w JOIN t USING (seg) JOIN tn ON t.w = tn.w GROUP BY ALL),
    d AS (SELECT term, cand, shared, sn.n AS occurrences, 2 * shared / (sn.n + tn.n) AS dice FROM j JOIN sn ON term = sn.w JOIN tn ON cand = tn.w),
    r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY dice DESC, shared DESC, cand) AS rn FROM d)
    SELECT term, cand AS rendering, CAST(occurrences AS BIGINT) AS occurrences, round(shared / occurrences, 6) AS consistency FROM r WHERE rn = 1 AND shared / occurrences >= 0.34"""
)
def a27_term_consistency(spark, sf):
    """The dominant rendering of each frequent term, candidates scored by the Dice coefficient over segments."""
    own = lambda c: F.filter(F.array_distinct(text.words(F.col(c))), lambda w: F.char_length(w) >= 4)
    both = pairs(spark, sf).select(own("left_text").alias("source"), own("right_text").alias("target"))
    counted = lambda side, word, n: both.select(F.explode(side).alias(word)).groupBy(word).agg(F.count("*").alias(n))
    total = both.agg(F.greatest(F.lit(1), F.floor(0.15 * F.count("*"))).alias("most"))
    terms = written(counted("source", "term", "occurrences").join(F.broadcast(total)).where("occurrences >= 3 AND occurrences <= most").drop("most"), "terms")
    cands = counted("target", "cand", "seen")
    # a segment's pairs are made and counted where the segment is, so only counts are shuffled
    met = both.select(F.explode("source").alias("term"), "target").join(leaks.bounded(terms), "term").select("term", "occurrences", F.explode("target").alias("cand"))
    met = met.groupBy("term", "cand", "occurrences").agg(F.count("*").alias("shared"))
    scored = met.join(cands, "cand").withColumn("dice", 2 * F.col("shared") / (F.col("occurrences") + F.col("seen")))
    best = dedup.first_copies(scored, ["term"], [F.desc("dice"), F.desc("shared"), "cand"])
    share = F.col("shared") / F.col("occurrences")
    return best.where(share >= 0.34).select("term", F.col("cand").alias("rendering"), "occurrences", F.round(share, 6).alias("consistency"))


@query(
    f"""WITH p AS (SELECT {TOKENS('lower(left_text)')} AS a, {TOKENS('lower(right_text)')} AS b FROM ({pairs_sql})), z AS (SELECT unnest(list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))])) AS z FROM p),
    c AS (SELECT z[1] AS word, z[2] AS reading, count(*) AS n FROM z GROUP BY ALL)
    SELECT word, reading, CAST(n AS BIGINT) AS n, CAST(readings AS BIGINT) AS readings FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, reading) AS rn, count(*) OVER (PARTITION BY word) AS readings FROM c) WHERE rn = 1"""
)
def a28_pronunciation_lexicon(spark, sf):
    """Words zipped with what stands at the same place; the most counted reading wins."""
    a, b = text.tokens(F.lower("left_text")), text.tokens(F.lower("right_text"))
    n = F.least(F.size(a), F.size(b))
    zipped = pairs(spark, sf).select(F.explode(F.arrays_zip(F.slice(a, F.lit(1), n).alias("word"), F.slice(b, F.lit(1), n).alias("reading"))).alias("z"))
    counts = zipped.groupBy("z.word", "z.reading").agg(F.count("*").alias("n"))
    best = counts.groupBy("word").agg(F.min(F.struct(-F.col("n"), F.col("reading"))).alias("m"), F.count("*").alias("readings"))
    return best.select("word", "m.reading", (-F.col("m.col1")).alias("n"), "readings")


@query("SELECT event_type, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, CAST(count(value) AS BIGINT) AS measured FROM events GROUP BY event_type")
def a29_distribution(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = table(spark, sf, "events").groupBy("event_type").agg(q.alias("q"), F.count("value").alias("measured"))
    return found.select("event_type", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 50, 90))], "measured")


@query("SELECT event_type, median(value) AS level FROM events GROUP BY event_type")
def a30_median_level(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("level"))


@query("SELECT CAST(ts AS DATE) AS revision, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a31_revision_histogram(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("revision")).agg(F.count("*").alias("n"))


@query("SELECT source, CAST(count(*) FILTER (contains(text, '|')) AS BIGINT) AS records, CAST(sum(length(text) - length(replace(text, '|', ''))) AS BIGINT) AS occurrences FROM documents GROUP BY source")
def a32_marker_audit(spark, sf):
    k = F.regexp_count("text", F.lit(r"\|"))
    return docs(spark, sf).groupBy("source").agg(F.count_if(k > 0).alias("records"), F.sum(k).cast("long").alias("occurrences"))


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY source, lang")
def a32_label_mix(spark, sf):
    counts = docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query("SELECT event_type, sum(value) AS nll, CAST(count(*) AS BIGINT) AS tokens, CAST(sum(length(props)) AS BIGINT) AS characters, CAST(count(*) FILTER (value > 100) AS BIGINT) AS truncated FROM events GROUP BY event_type")
def a33_likelihood_sums(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.sum("value").alias("nll"), F.count("*").alias("tokens"), F.sum(F.char_length("props")).alias("characters"), F.count_if(F.col("value") > 100).alias("truncated")
    )


@query(
    """WITH c AS (SELECT c_mktsegment AS condition, sum(c_acctbal) / 100 / count(*) AS cer FROM customer GROUP BY 1), f AS (SELECT cer AS floor FROM c WHERE condition = 'BUILDING')
    SELECT condition, round(cer - floor, 6) AS delta, abs(cer - floor) <= 5 AS within FROM c, f"""
)
def a34_control_delta(spark, sf):
    """Each condition against the floor row, of which there is one."""
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("condition")).agg((F.sum("c_acctbal") / 100 / F.count("*")).alias("cer"))
    floor = c.where("condition = 'BUILDING'").select(F.col("cer").alias("floor"))
    d = F.col("cer") - F.col("floor")
    return c.join(F.broadcast(floor)).select("condition", F.round(d, 6).alias("delta"), (F.abs(d) <= 5).alias("within"))


@query(f"WITH f AS (SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS('text')}) AS w FROM documents) GROUP BY w) SELECT {CLASS_SQL} AS class, CAST(count(*) AS BIGINT) AS types, CAST(sum(n) AS BIGINT) AS tokens, CAST(count(*) FILTER (n = 1) AS BIGINT) AS hapax FROM f GROUP BY 1")
def a36_vocabulary_report(spark, sf):
    freq = a20_word_frequencies(spark, sf)
    return freq.groupBy(word_class(F.col("word")).alias("class")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("hapax"))


@query(f"SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS characters, CAST(len({TOKENS('text')}) AS BIGINT) AS words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS paragraphs FROM documents")
def a37_document_measures(spark, sf):
    t = F.col("text")
    paragraphs = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    return docs(spark, sf).select(
        "doc_id", F.sha2(t, 256).alias("digest"), F.octet_length(t).cast("long").alias("bytes"), F.char_length(t).cast("long").alias("characters"), F.size(text.tokens(t)).cast("long").alias("words"), paragraphs.cast("long").alias("paragraphs")
    )


@query(whole.ORACLES["a39_whole_references"])
def a39_corrected_against_uncorrected(spark, sf):
    """Whole texts against their lower case."""
    return whole.a39_whole_references(spark, sf)


VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


PREFIXES = (64, 32, 16)


def retrieval_pairs(spark, sf):
    """A stated query set, each query with the row after it as its target, and all rows as passages."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id % 20 = 0").withColumn("target", F.col("id") + 1)
    return q.join(e.select(F.col("id").alias("target"), F.col("v").alias("t")), "target"), e


@query(
    f"""WITH q AS (SELECT vec_id, label, v FROM ({VEC}) WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id, e.vec_id AS other, round(list_cosine_similarity(q.v, e.v), 9) AS sim, e.vec_id = q.vec_id + 1 AS target FROM q JOIN ({VEC}) e ON e.vec_id <> q.vec_id),
    t AS (SELECT vec_id, sim AS hit FROM s WHERE target), r AS (SELECT s.vec_id, 1 + count(*) FILTER (sim > hit) AS rank FROM s JOIN t USING (vec_id) GROUP BY s.vec_id)
    SELECT round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS recall_at_5, round(avg(1 / rank), 6) AS mrr FROM r"""
)
def v01_retrieval_metrics(spark, sf):
    """A stated query set against all passages: rank is one more than the passages strictly nearer than the target."""
    queries, passages = retrieval_pairs(spark, sf)
    found = retrieval.metrics(retrieval.ranks(queries, passages, PREFIXES[:1]))
    return found.select(F.round("recall_at_5", 6).alias("recall_at_5"), F.round("mrr", 6).alias("mrr"))


@query(
    f"""WITH d AS (SELECT unnest({list(PREFIXES)}) AS dims), e AS (SELECT dims, vec_id, v[:dims] AS v FROM ({VEC}), d), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
    s AS (SELECT q.dims, q.vec_id, round(list_cosine_similarity(q.v, e.v), 9) AS sim, e.vec_id = q.vec_id + 1 AS target FROM q JOIN e ON e.dims = q.dims AND e.vec_id <> q.vec_id),
    t AS (SELECT dims, vec_id, sim AS hit FROM s WHERE target), r AS (SELECT dims, s.vec_id, hit, 1 + count(*) FILTER (sim > hit) AS rank, sum(sim) FILTER (NOT target) AS others, count(*) FILTER (NOT target) AS n FROM s JOIN t USING (dims, vec_id) GROUP BY ALL)
    SELECT CAST(dims AS INTEGER) AS dims, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS recall_at_1, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS recall_at_5, round(avg(1 / rank), 6) AS mrr, round(avg(hit), 6) AS mean_positive,
    round(sum(others) / sum(n), 6) AS mean_negative, round(avg(hit) - sum(others) / sum(n), 6) AS margin FROM r GROUP BY dims"""
)
def v01_metrics_by_prefix(spark, sf):
    """All measures of retrieval, for the whole vectors and their leading dimensions."""
    found = retrieval.metrics(retrieval.ranks(*retrieval_pairs(spark, sf), PREFIXES))
    return found.select("dims", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr", "mean_positive", "mean_negative", "margin")])


@query(
    f"""SELECT q AS query, other AS neighbour FROM (SELECT q.vec_id AS q, e.vec_id AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS rn
    FROM ({VEC}) q JOIN ({VEC}) e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rn <= 3"""
)
def v02_nearest_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.nearest(e.where("id % 20 = 0"), e, 3).select("query", "neighbour")


@query(
    f"""WITH e AS ({VEC}), q AS (SELECT a.vec_id AS vec_id, list_transform(range(1, 65), lambda i: a.v[i] - b.v[i] + c.v[i]) AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 10 = 0)
    SELECT query, neighbour, round(sim, 6) AS cosine, CAST(place AS INTEGER) AS place FROM (SELECT q.vec_id AS query, e.vec_id AS neighbour, round(list_cosine_similarity(q.v, e.v), 9) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS place
    FROM q JOIN e ON e.vec_id NOT BETWEEN q.vec_id AND q.vec_id + 2) WHERE place <= 5"""
)
def v02_analogies(spark, sf):
    """a - b + c for each tenth row and the two after it: the three are over-fetched and then left out."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    at = lambda k: e.select((F.col("id") - k).alias("id"), F.col("v").alias(f"v{k}")).where("id % 10 = 0")
    three = at(0).join(at(1), "id").join(at(2), "id")
    v = F.zip_with(F.zip_with("v0", "v1", lambda a, b: a - b), "v2", lambda a, c: a + c)
    near = retrieval.nearest(three.select("id", v.alias("v")), e, 5 + 3, excluded=False).where(~F.col("neighbour").between(F.col("query"), F.col("query") + 2))
    order = Window.partitionBy("query").orderBy("place")
    return near.withColumn("place", F.row_number().over(order)).where("place <= 5").select("query", "neighbour", F.round("cosine", 6).alias("cosine"), "place")


@query(whole.ORACLES["v03_whole_vocabulary"])
def v03_reachable_vocabulary(spark, sf):
    """New ids by ascending order, of the words of all documents."""
    return whole.v03_whole_vocabulary(spark, sf)


@query("SELECT DISTINCT c AS character, CASE WHEN lower(c) <> c AND regexp_matches(lower(c), '[a-z]') THEN lower(c) ELSE translate(c, 'éèêçñóíáüöäß', 'eeecnoiauoas') END AS donor FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE regexp_matches(c, '[^a-z]') AND regexp_matches(c, '\\p{L}')")
def v04_donor_characters(spark, sf):
    """Missing letters and what stands in: lower case first, then a table."""
    chars = docs(spark, sf).select(F.explode(F.array_distinct(F.split("text", ""))).alias("character")).distinct()
    c = F.col("character")
    donor = F.when((F.lower(c) != c) & F.lower(c).rlike("[a-z]"), F.lower(c)).otherwise(F.translate(c, "éèêçñóíáüöäß", "eeecnoiauoas"))
    return chars.where(c.rlike("[^a-z]") & c.rlike(r"\p{L}")).select("character", donor.alias("donor"))


@query("SELECT lang, condition, round(sum(length(regexp_replace(CASE condition WHEN 'raw' THEN text ELSE lower(text) END, '[a-z ]', '', 'g'))) / sum(length(text)), 6) AS unknown FROM documents, (VALUES ('raw'), ('lower')) v(condition) GROUP BY ALL")
def v05_condition_grid(spark, sf):
    both = docs(spark, sf).select("lang", F.char_length("text").alias("n"), F.explode(F.create_map(F.lit("raw"), "text", F.lit("lower"), F.lower("text"))).alias("condition", "t"))
    return both.groupBy("lang", "condition").agg(F.round(F.sum(F.regexp_count("t", F.lit("[^a-z ]"))) / F.sum("n"), 6).alias("unknown"))


@query(
    """WITH i AS (SELECT doc_id, list_transform(string_split(substr(sha256(text), 1, 24), ''), lambda c: CAST('0x' || c AS INTEGER) % 4) AS ids FROM documents)
    SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(ids) + 1), lambda k: CASE WHEN k = 1 OR ids[k] <> ids[k - 1] THEN ids[k] END), lambda x: x IS NOT NULL AND x <> 0), '') AS decoded FROM i"""
)
def v06_ctc_decode(spark, sf):
    digits = F.filter(F.split(F.substring(F.sha2("text", 256), 1, 24), ""), lambda c: c != "")
    ids = F.transform(digits, lambda c: (F.conv(c, 16, 10).cast("int") % 4))
    return docs(spark, sf).select("doc_id", F.array_join(F.transform(text.ctc_collapse(ids, 0), lambda x: x.cast("string")), "").alias("decoded"))


@query("SELECT n_nationkey AS id, CASE n_nationkey WHEN 0 THEN '' WHEN 4 THEN ' ' ELSE lower(n_name) END AS label FROM nation")
def v07_decoder_labels(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.alias("id"), F.when(n == 0, "").when(n == 4, " ").otherwise(F.lower("n_name")).alias("label")).orderBy("id")


@query(f"SELECT lang, CAST(sum(least(length(w), 4)) AS BIGINT) AS pieces, CAST(count(*) AS BIGINT) AS labels FROM (SELECT lang, unnest({TOKENS('text')}[1:60]) AS w FROM documents) GROUP BY lang")
def v08_label_projection(spark, sf):
    """One label on the first piece of each word, words past the budget dropped whole; here pieces are four characters at most."""
    w = docs(spark, sf).select("lang", F.explode(F.slice(text.tokens(F.col("text")), 1, 60)).alias("w"))
    return w.groupBy("lang").agg(F.sum(F.least(F.char_length("w"), F.lit(4))).cast("long").alias("pieces"), F.count("*").alias("labels"))


@query("SELECT n_name, array_to_string(list_transform(string_split(lower(n_name), ''), lambda c: CAST(strpos('abcdefghijklmnopqrstuvwxyz', c) AS VARCHAR)), ' ') AS ids FROM nation")
def v09_symbol_rows(spark, sf):
    chars = F.filter(F.split(F.lower("n_name"), ""), lambda c: c != "")
    rows = F.create_map(*[F.lit(x) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", start=1) for x in (c, str(i))])
    ids = F.transform(chars, lambda c: F.coalesce(F.try_element_at(rows, c), F.lit("0")))
    return table(spark, sf, "nation").select("n_name", F.array_join(ids, " ").alias("ids"))


@query(f"SELECT conv_id, turn, CASE WHEN length(right_text) < 40 THEN upper(right_text) ELSE right_text END AS final FROM ({pairs_sql})")
def v10_two_pass_repair(spark, sf):
    """Rows that fail are computed again and put back."""
    first = pairs(spark, sf).select("conv_id", "turn", "right_text")
    again = first.where(F.char_length("right_text") < 40).select("conv_id", "turn", F.upper("right_text").alias("again"))
    return first.join(again, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("again", "right_text").alias("final"))


@query(f"WITH w AS (SELECT role, w, count(*) AS n FROM (SELECT role, unnest({WORDS}) AS w FROM conversations WHERE role <> 'system') GROUP BY ALL) SELECT role, w AS word, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS rn FROM w) WHERE rn <= 10")
def v12_common_words_by_side(spark, sf):
    counts = table(spark, sf, "conversations").where("role <> 'system'").select("role", F.explode(text.words(F.col("text"))).alias("word")).groupBy("role", "word").agg(F.count("*").alias("n"))
    return dedup.first_per_group(counts, ["role"], [F.desc("n"), "word"], 10)


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, right_text, row_number() OVER (PARTITION BY {KEY_SQL.format('left_text')} ORDER BY conv_id, turn) AS rn FROM ({pairs_sql})) WHERE rn = 1 AND len({TOKENS('right_text')}) BETWEEN 3 AND 40 AND NOT regexp_matches(right_text, '[<>{{}}]')")
def v13_labelling_candidates(spark, sf):
    first = dedup.first_copies(keyed(pairs(spark, sf), "left_text"), ["key"], ["conv_id", "turn"])
    r = F.col("right_text")
    return first.where(F.size(text.tokens(r)).between(3, 40) & ~r.rlike("[<>{}]")).select("conv_id", "turn")


@query(f"SELECT round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS system, round(sum(levenshtein(ref, lower(ref))) / sum(length(ref)), 6) AS copy_floor FROM ({NAMES_SQL})")
def v14_system_against_floor(spark, sf):
    size = F.char_length("ref")
    return name_pairs(spark, sf).agg(F.round(scores.error_rate(F.levenshtein("ref", "hyp"), size), 6).alias("system"), F.round(scores.error_rate(F.levenshtein(F.col("ref"), F.lower("ref")), size), 6).alias("copy_floor"))


@query("SELECT s_name FROM supplier WHERE s_nationkey IN (1, 3) AND s_acctbal > 0")
def v17_catalogue_filter(spark, sf):
    """Optional predicates, all of which must hold."""
    wanted = {"s_nationkey": F.col("s_nationkey").isin(1, 3), "s_acctbal": F.col("s_acctbal") > 0}
    found = table(spark, sf, "supplier")
    for test in wanted.values():
        found = found.where(test)
    return found.select("s_name")


@query("SELECT CASE WHEN n_chars > 5000 THEN 'volume' WHEN lang = 'en' THEN 'bucket' ELSE 'local' END AS target, CAST(count(*) AS BIGINT) AS sources, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def v18_placement_summary(spark, sf):
    target = F.when(F.col("n_chars") > 5000, "volume").when(F.col("lang") == "en", "bucket").otherwise("local")
    return docs(spark, sf).groupBy(target.alias("target")).agg(F.count("*").alias("sources"), F.sum("n_chars").alias("bytes"))


@query("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
def v22_reference_order(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text").orderBy("conv_id", "turn")


@query(f"""SELECT c, c || ' U+' || format('{{:04X}}', unicode(c)) || ' ' || coalesce(list_extract([{', '.join(map(forms.quoted, forms.NAMES.values()))}], list_position([{', '.join(map(forms.quoted, forms.NAMES))}], c)), 'UNNAMED') AS description
    FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''""")
def v23_described_characters(spark, sf):
    chars = docs(spark, sf).select(F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct()
    return chars.select("c", normalise.described(F.col("c")).alias("description"))


@query("SELECT doc_id, regexp_replace(text, '^[^\\n]*', 'Title') AS retitled FROM documents")
def v24_retitled(spark, sf):
    return docs(spark, sf).select("doc_id", F.regexp_replace("text", r"\A[^\n]*", "Title").alias("retitled"))


@query(whole.ORACLES["v25_stream_windows"])
def v25_token_windows(spark, sf):
    """Windows over one stream of tokens."""
    return whole.v25_stream_windows(spark, sf)


@query("SELECT name, round(avg(CASE WHEN n_chars > 0 THEN share END), 6) AS score FROM (SELECT 'text' AS name, length(text) AS n_chars, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text) AS share FROM documents UNION ALL SELECT 'source', length(source), length(regexp_replace(source, '[^\\p{L}]', '', 'g')) / length(source) FROM documents) GROUP BY name")
def c01_column_scores(spark, sf):
    """One aggregate pass scores every string column by content; the choice is the caller's."""
    columns = ["text", "source"]
    scored = docs(spark, sf).agg(*[F.avg(text.letter_ratio(F.col(c))).alias(c) for c in columns])
    return scored.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("name", "score")).withColumn("score", F.round("score", 6))


@query(
    f"""WITH r AS (SELECT lang, sum(len(list_filter({WORDS}, lambda w: w IN ('the', 'of', 'and', 'to', 'in')))) / sum(len({WORDS})) AS en, sum(len(list_filter({WORDS}, lambda w: w IN ('le', 'la', 'les', 'de', 'des')))) / sum(len({WORDS})) AS fr FROM documents GROUP BY lang)
    SELECT lang, CASE WHEN en < 0.08 AND fr < 0.08 THEN 'other' WHEN en >= 1.5 * fr THEN 'eng' WHEN fr >= 1.5 * en THEN 'fra' ELSE 'other' END AS claimed FROM r"""
)
def c03_column_language(spark, sf):
    own = text.words(F.col("text"))
    rate = lambda ws: F.sum(F.size(F.filter(own, lambda w: w.isin(ws)))) / F.sum(F.size(own))
    r = docs(spark, sf).groupBy("lang").agg(rate(["the", "of", "and", "to", "in"]).alias("en"), rate(["le", "la", "les", "de", "des"]).alias("fr"))
    en, fr = F.col("en"), F.col("fr")
    claimed = F.when((en < 0.08) & (fr < 0.08), "other").when(en >= 1.5 * fr, "eng").when(fr >= 1.5 * en, "fra").otherwise("other")
    return r.select("lang", claimed.alias("claimed"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS own_side FROM conversations WHERE role <> 'system'")
def c04_side_by_direction(spark, sf):
    return table(spark, sf, "conversations").where("role <> 'system'").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("own_side"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s08_flattened_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def x_tpch_q1(spark, sf):
    """Not of the reference: a star-schema aggregate for the bench."""
    rows = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


