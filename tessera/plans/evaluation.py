"""Scans, scores and choices in their full form: contamination by kind, translation metrics, remapped vocabularies, label
arrays, repairs, column choice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import align, corrupt, labels, normalise, text
from tessera.operators import columns, dedup, leaks, lexicon, scores, splits
from tessera.plans import forms
from tessera.plans.files import folder
from tessera.plans.relations import J02, LEXICON_SQL
from tessera.plans.relations import lexicon as word_list
from tessera.plans.shared import ORTHOGRAPHY_SQL, TOKENS, WORDS, docs, in_orthography, pairs, pairs_sql
from tessera.plans.texts import FREE_SQL
from tessera.session import table, written
from tessera.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SCAN = f"""{J02}, e AS (SELECT doc_id, item_id FROM (SELECT doc_id, {forms.duplicate_key('text')} AS key FROM documents) JOIN (SELECT item_id, unnest([{forms.duplicate_key('text')}, {forms.duplicate_key(forms.normal_form('text'))}]) AS key FROM benchmark) USING (key)),
    h AS (SELECT item_id, doc_id, 'exact' AS kind FROM e UNION ALL SELECT item_id, doc_id, 'ngram' FROM m WHERE doc_id NOT IN (SELECT doc_id FROM e)),
    leaked AS (SELECT item_id, min(doc_id) AS doc_id, arg_min(kind, doc_id) AS kind FROM h GROUP BY item_id)"""


def leaked(spark, sf):
    """Items that documents hold whole or by an n-gram, each credited to its least document. The first item of a
    document is also looked for by itself, as some documents are items."""
    bench = table(spark, sf, "benchmark")
    own = docs(spark, sf).select("doc_id", "source", "text", normalise.fingerprint(F.col("text")).alias("key"))
    items = bench.select("item_id", "text", F.array_distinct(F.array(normalise.fingerprint(F.col("text")), normalise.fingerprint(normalise.normalised(F.col("text"))))).alias("key"))
    return leaks.scan(own, items, "doc_id", "item_id")


@query(f"WITH {SCAN} SELECT item_id, kind, doc_id FROM leaked")
def j02_scan(spark, sf):
    return leaked(spark, sf)


@query(f"WITH {SCAN} SELECT source, kind, CAST(count(*) AS BIGINT) AS items FROM leaked JOIN documents USING (doc_id) GROUP BY ALL")
def j02_counts_by_source(spark, sf):
    return leaked(spark, sf).join(docs(spark, sf).select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("items"))


@query(f"WITH {SCAN} SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM benchmark), 6) AS rate, round(count(DISTINCT item_id) FILTER (kind = 'exact') / (SELECT count(*) FROM benchmark), 6) AS exact_rate FROM leaked")
def a05_rate_by_kind(spark, sf):
    n = table(spark, sf, "benchmark").agg(F.count("*").alias("n"))
    rate = lambda c: F.round(F.count(c) / F.first("n"), 6)
    return leaked(spark, sf).join(F.broadcast(n)).agg(rate("item_id").alias("rate"), rate(F.when(F.col("kind") == "exact", F.col("item_id"))).alias("exact_rate"))


def bleu_words(column: str) -> str:
    out = f"replace(replace(replace({column}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, plain in scores.ENTITIES:
        out = f"replace({out}, '{entity}', '{plain}')"
    out = f"(' ' || {out} || ' ')"
    for pattern, new in scores.BLEU_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return TOKENS(out)


def parted(column: str) -> str:
    marks = scores.MARKS.replace("'", "''")
    return f"""flatten(list_transform({TOKENS(column)}, lambda w: CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(w, '{marks}$') THEN [w[:length(w) - 1], w[length(w):]] WHEN regexp_matches(w, '^{marks}') THEN [w[1:1], w[2:]] ELSE [w] END))"""


def letters(column: str) -> str:
    return f"list_filter(string_split(regexp_replace({column}, '\\s+', '', 'g'), ''), lambda c: c <> '')"


def counted(units, kinds: dict[str, int]) -> str:
    """Totals (kind, n, shared, of_ref, of_hyp) of the rows rows_(id, ref, hyp)."""
    each = lambda side: " UNION ALL ".join(f"SELECT id, '{k}' AS kind, {n} AS n, unnest(list_transform(range(1, len(u) - {n - 2}), lambda i: array_to_string(u[i:i + {n - 1}], chr(31)))) AS g FROM (SELECT id, {units[k](side)} AS u FROM rows_)" for k, most in kinds.items() for n in range(1, most + 1))
    return f"""r_ AS (SELECT id, kind, n, g, count(*) AS c FROM ({each('ref')}) GROUP BY ALL), h_ AS (SELECT id, kind, n, g, count(*) AS c FROM ({each('hyp')}) GROUP BY ALL),
    t_ AS (SELECT kind, n, sum(least(coalesce(r_.c, 0), coalesce(h_.c, 0))) AS shared, sum(coalesce(r_.c, 0)) AS of_ref, sum(coalesce(h_.c, 0)) AS of_hyp FROM r_ FULL OUTER JOIN h_ USING (id, kind, n, g) GROUP BY kind, n)"""


ROWS = "rows_ AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, {0} AS ref, {1} AS hyp FROM (" + pairs_sql + "))"
TYPED = "translate(" + ORTHOGRAPHY_SQL.format("{}") + ", 'ɛɣƐƔ', 'εγΣΓ')"
CONDITIONS = {"raw": (ORTHOGRAPHY_SQL.format("left_text"), TYPED.format("right_text")), "normalised": (forms.normal_form(ORTHOGRAPHY_SQL.format("left_text")), forms.normal_form(TYPED.format("right_text")))}
CHRF_SQL = "SELECT 100 * 5 * avg(shared / of_hyp) * avg(shared / of_ref) / (4 * avg(shared / of_hyp) + avg(shared / of_ref)) AS chrf FROM t_ WHERE of_ref > 0 AND of_hyp > 0"
BLEU_SQL = """SELECT 100 * CASE WHEN max(of_hyp) FILTER (n = 1) < max(of_ref) FILTER (n = 1) THEN exp(1 - max(of_ref) FILTER (n = 1) / max(of_hyp) FILTER (n = 1)) ELSE 1 END
    * exp(avg(ln(CASE WHEN shared > 0 THEN shared / of_hyp ELSE 1 / (power(2, missed) * of_hyp) END))) AS bleu FROM (SELECT *, count(*) FILTER (shared = 0) OVER (ORDER BY n) AS missed FROM t_ WHERE of_hyp > 0)"""


def metric_sql(condition: str) -> str:
    rows = ROWS.format(*CONDITIONS[condition])
    chrf = f"(WITH {rows}, {counted({'char': letters, 'word': parted}, {'char': 6, 'word': 2})} {CHRF_SQL})"
    bleu = f"(WITH {rows}, {counted({'w': bleu_words}, {'w': 4})} {BLEU_SQL})"
    return f"SELECT '{condition}' AS condition, round({chrf}, 4) AS chrf, round({bleu}, 4) AS bleu"


@query(f"WITH s AS ({metric_sql('raw')} UNION ALL {metric_sql('normalised')}) SELECT condition, chrf, bleu, round(chrf - (SELECT chrf FROM s WHERE condition = 'raw'), 4) AS gap FROM s")
def a14_translation_metrics(spark, sf):
    """Replies against their questions, typed with the letters of another keyboard: as they are, and both sides in
    canonical form; the gap is what canonical form is worth."""
    rows = pairs(spark, sf).select(in_orthography(F.col("left_text")).alias("ref"), corrupt.lookalike(in_orthography(F.col("right_text"))).alias("hyp"))
    both = {"raw": rows, "normalised": rows.select(normalise.normalised(F.col("ref")).alias("ref"), normalise.normalised(F.col("hyp")).alias("hyp"))}
    found = None
    for name, texts in both.items():
        # two scores read the texts, several units each
        own = written(texts, name)
        one = scores.chrf(own, "ref", "hyp").join(scores.bleu(own, "ref", "hyp")).select(F.lit(name).alias("condition"), F.round("chrf", 4).alias("chrf"), F.round("bleu", 4).alias("bleu"))
        found = one if found is None else found.unionByName(one)
    # two rows
    raw = found.where("condition = 'raw'").select(F.col("chrf").alias("raw"))
    return found.join(F.broadcast(raw)).select("condition", "chrf", "bleu", F.round(F.col("chrf") - F.col("raw"), 4).alias("gap"))


@query(
    """WITH q AS (SELECT list_transform(range(1, 65), lambda i: a.embedding[i] - b.embedding[i] + c.embedding[i])::DOUBLE[] AS v FROM embeddings a, embeddings b, embeddings c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) AS cosine FROM embeddings, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 9) DESC, vec_id LIMIT 10"""
)
def v02_analogy(spark, sf):
    """What is to 3 as 1 is to 2: the nearest ten but for the three themselves."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    terms = {r["vec_id"]: r["v"] for r in e.where(F.col("vec_id").isin(1, 2, 3)).collect()}
    target = F.array(*[F.lit(a - b + c) for a, b, c in zip(terms[1], terms[2], terms[3], strict=True)])
    near = e.where(~F.col("vec_id").isin(1, 2, 3)).withColumn("c", text.cosine(F.col("v"), target))
    return near.orderBy(F.desc(F.round("c", 9)), "vec_id").limit(10).select("vec_id", F.round("c", 5).alias("cosine"))


REMAP = f"""kept AS (SELECT w AS id, 2 + row_number() OVER (ORDER BY w) AS new_id FROM (SELECT DISTINCT unnest({WORDS}) AS w FROM documents WHERE lang = 'en'))"""


@query(f"WITH {REMAP}, w AS (SELECT lang, unnest({WORDS}) AS id FROM documents) SELECT lang, CAST(count(*) FILTER (new_id IS NULL) AS BIGINT) AS unknown, CAST(sum(coalesce(new_id, 1)) AS BIGINT) AS checksum FROM w LEFT JOIN kept USING (id) GROUP BY lang")
def v03_remapped(spark, sf):
    """The vocabulary that the English documents reach, after three ids that are always kept; words of others become the
    unknown id, 1."""
    # each language's distinct words are looked up once
    words = docs(spark, sf).select("lang", F.explode(text.words(F.col("text"))).alias("id")).groupBy("lang", "id").agg(F.count("*").alias("n"))
    from tessera.plans.whole import vocabulary_ids

    kept = vocabulary_ids(docs(spark, sf).where("lang = 'en'")).select(F.col("word").alias("id"), (F.col("new_id") + 3).alias("new_id"))
    found = scores.remapped(words, kept, strict=False, unknown=1)
    return found.groupBy("lang").agg(F.sum(F.when(F.col("new_id") == 1, F.col("n")).otherwise(0)).alias("unknown"), F.sum(F.col("new_id") * F.col("n")).alias("checksum"))


BUDGET = 64


@query(
    f"""WITH w AS (SELECT doc_id, {TOKENS('text')} AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM w),
    p AS (SELECT *, (length(w) + 3) // 4 AS n, sum((length(w) + 3) // 4) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u),
    k AS (SELECT doc_id, sum(n) FILTER (upto <= {BUDGET - 2}) AS pieces, count(*) FILTER (upto <= {BUDGET - 2}) AS words, sum(length(w) % 3) FILTER (upto <= {BUDGET - 2}) AS labels FROM p GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(pieces, 0) + 2 AS INTEGER) AS size, CAST(words AS INTEGER) AS words, CAST(coalesce(labels, 0) - 100 * (coalesce(pieces, 0) + 2 - words) AS BIGINT) AS checksum FROM k"""
)
def v08_label_arrays(spark, sf):
    """Pieces are four characters at most, a word's label is its length by 3; whole words up to the budget."""
    tokens = text.tokens(F.col("text"))
    pieces = F.transform(tokens, lambda w: F.floor((F.char_length(w) + 3) / 4).cast("int"))
    own = F.transform(tokens, lambda w: F.char_length(w) % 3)
    # no more words than the budget can be taken
    rows = docs(spark, sf).select("doc_id", F.slice(tokens, 1, BUDGET).alias("t"), F.slice(pieces, 1, BUDGET).alias("p"), F.slice(own, 1, BUDGET).alias("l")).where(F.size("t") > 0)
    out = rows.select("doc_id", scores.projected(F.col("t"), F.col("p"), F.col("l"), BUDGET).alias("a"))
    return out.select("doc_id", F.size("a").alias("size"), F.size(F.filter("a", lambda x: x != -100)).alias("words"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


FIRST = "CASE turn % 4 WHEN 0 THEN left_text WHEN 1 THEN '' ELSE right_text END"
FAILED_OF = lambda out: forms.column_of(forms.FAILED, "text").replace("right_text", out)
LISTS = f"{TOKENS('left_text')} AS lt, {TOKENS('{0}')} AS rt, regexp_extract_all(lower(left_text), '\\p{{{{L}}}}+') AS lw, regexp_extract_all(lower({{0}}), '\\p{{{{L}}}}+') AS rw"


@query(
    f"""WITH a AS (SELECT *, {FIRST} AS one FROM ({pairs_sql})), b AS (SELECT *, {FAILED_OF('one')} AS bad FROM (SELECT *, {LISTS.format('one')} FROM a)),
    c AS (SELECT * EXCLUDE (lt, rt, lw, rw), CASE WHEN bad AND conv_id % 2 = 0 THEN right_text ELSE one END AS two FROM b), d AS (SELECT *, {FAILED_OF('two')} AS still FROM (SELECT *, {LISTS.format('two')} FROM c))
    SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (bad) AS BIGINT) AS failed, CAST(count(*) FILTER (bad AND still) AS BIGINT) AS still, CAST(sum(length(two)) AS BIGINT) AS chars FROM d"""
)
def v10_failures_repaired(spark, sf):
    """Half of the outputs are copies or empty; those that fail are made again, for every other conversation with success, and put back."""
    rows = pairs(spark, sf).withColumn("one", F.when(F.col("turn") % 4 == 0, F.col("left_text")).when(F.col("turn") % 4 == 1, "").otherwise(F.col("right_text")))
    key = ["conv_id", "turn"]
    failed = rows.where(text.failed_translation(F.col("left_text"), F.col("one")))
    again = failed.select(*key, F.when(F.col("conv_id") % 2 == 0, F.col("right_text")).otherwise(F.col("one")).alias("again"))
    done = rows.join(again, key, "left").select("left_text", F.coalesce("again", "one").alias("two"), F.col("again").isNotNull().alias("bad"))
    still = F.col("bad") & text.failed_translation(F.col("left_text"), F.col("two"))
    return done.agg(F.count("*").alias("rows"), F.count_if("bad").alias("failed"), F.count_if(still).alias("still"), F.sum(F.char_length("two")).alias("chars"))


@query(
    f"""WITH s AS (SELECT unnest([{{'code': CASE turn % 3 WHEN 0 THEN 'kab' ELSE 'eng' END, 't': left_text}}, {{'code': CASE turn % 3 WHEN 0 THEN 'fra' ELSE 'kab' END, 't': right_text}}]) AS s FROM ({pairs_sql})),
    w AS (SELECT s.code AS code, unnest(regexp_extract_all(lower(s.t), '\\p{{L}}+')) AS word FROM s WHERE s.code <> 'kab'), c AS (SELECT code, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT code, word, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, word) AS k FROM c) WHERE k <= 10"""
)
def v12_common_words_by_direction(spark, sf):
    """A direction names both sides' languages; the own language is left out, the others' ten commonest words stay. The limit is the feature."""
    direction = F.when(F.col("turn") % 3 == 0, "kab-fra").otherwise("eng-kab")
    sides = F.arrays_zip(F.split(direction, "-").alias("code"), F.array("left_text", "right_text").alias("t"))
    rows = pairs(spark, sf).select(F.inline(sides)).where("code <> 'kab'")
    counts = rows.select("code", F.explode(text.words(F.col("t"))).alias("word")).groupBy("code", "word").agg(F.count("*").alias("n"))
    return dedup.first_per_group(counts, ["code"], [F.desc("n"), "word"], 10)


VOCABULARY = f"v AS (SELECT w FROM (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS k FROM (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents WHERE lang = 'en') GROUP BY w)) WHERE k <= 500)"


@query(
    f"""WITH {VOCABULARY}, w AS (SELECT lang, unnest({WORDS}) AS w FROM documents), m AS (SELECT lang, CASE WHEN v.w IS NULL THEN length(w.w) ELSE 1 END AS pieces, CASE WHEN v.w IS NULL THEN length(regexp_replace(w.w, '[a-z]', '', 'g')) ELSE 0 END AS unknown FROM w LEFT JOIN v ON w.w = v.w),
    f AS (SELECT lang, sum(pieces) / count(*) AS rate, sum(unknown) / sum(pieces) AS share FROM m GROUP BY lang) SELECT lang, round(rate, 6) AS pieces_per_word, round(share, 6) AS unknown_share, round(rate / (SELECT rate FROM f WHERE lang = 'en'), 6) AS to_reference FROM f"""
)
def a24_encoder_fertility(spark, sf):
    """An encoder of 500 whole words and single letters: pieces a word, the share of letters it has not, and both against English."""
    words = docs(spark, sf).select("lang", F.explode(text.words(F.col("text"))).alias("w"))
    counts = words.where("lang = 'en'").groupBy("w").agg(F.count("*").alias("n"))
    # 500 rows
    known = F.broadcast(counts.orderBy(F.desc("n"), "w").limit(500).select("w", F.lit(True).alias("known")))
    m = words.join(known, "w", "left")
    pieces = F.when(F.col("known"), 1).otherwise(F.char_length("w"))
    unknown = F.when(F.col("known"), 0).otherwise(F.char_length(F.regexp_replace("w", "[a-z]", "")))
    f = m.groupBy("lang").agg((F.sum(pieces) / F.count("*")).alias("rate"), (F.sum(unknown) / F.sum(pieces)).alias("share"))
    reference = f.where("lang = 'en'").select(F.col("rate").alias("reference"))
    return f.join(F.broadcast(reference)).select("lang", F.round("rate", 6).alias("pieces_per_word"), F.round("share", 6).alias("unknown_share"), F.round(F.col("rate") / F.col("reference"), 6).alias("to_reference"))


GRID = {"stock": "[^a-z]", "repaired": "[^a-zɛɣ]"}


@query(
    f"""WITH t AS (SELECT lang, unnest([{{'c': 'raw', 't': {TYPED.format('text')}}}, {{'c': 'normalised', 't': {forms.normal_form(TYPED.format('text'))}}}]) AS s FROM documents),
    l AS (SELECT lang, s.c AS condition, regexp_replace(lower(s.t), '[^\\p{{L}}]', '', 'g') AS x FROM t)
    SELECT lang, condition, {', '.join(f"round(1 - sum(length(regexp_replace(x, '[{p[2:]}', '', 'g'))) / sum(length(x)), 6) AS known_{n}" for n, p in GRID.items())} FROM l GROUP BY lang, condition"""
)
def v05_grid(spark, sf):
    """Letters known to two vocabularies, without and with the orthography's, under two conditions of the text: as typed on
    another keyboard, and in canonical form."""
    typed = corrupt.lookalike(in_orthography(F.col("text")))
    rows = docs(spark, sf).select("lang", typed.alias("t")).select("lang", F.explode(F.create_map(F.lit("raw"), "t", F.lit("normalised"), normalise.normalised(F.col("t")))).alias("condition", "t"))
    x = F.regexp_replace(F.lower("t"), r"[^\p{L}]", "")
    known = lambda p: F.round(1 - F.sum(F.regexp_count(x, F.lit(p))) / F.sum(F.char_length(x)), 6)
    return rows.groupBy("lang", "condition").agg(*[known(p).alias(f"known_{n}") for n, p in GRID.items()])


@query(f"SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS dice FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(left_text), '\\p{{L}}+')) AS a, list_distinct(regexp_extract_all(lower(right_text), '\\p{{L}}+')) AS b FROM ({pairs_sql}))")
def m18_dice(spark, sf):
    own = lambda c: F.array_distinct(text.words(F.col(c)))
    return pairs(spark, sf).select("conv_id", "turn", F.round(scores.dice(own("left_text"), own("right_text")), 6).alias("dice"))


@query(
    """SELECT event_type, CAST(quarter(ts) AS INTEGER) * 1000 + user_id % 3 AS rate, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, CAST(count(value) AS BIGINT) AS measured, CAST(count(*) AS BIGINT) AS clips
    FROM events GROUP BY GROUPING SETS ((event_type), (event_type, CAST(quarter(ts) AS INTEGER) * 1000 + user_id % 3))"""
)
def a29_summary_by_rate(spark, sf):
    """Percentiles of a measure with the number measured, for each group and within it for each rate."""
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    rows = table(spark, sf, "events").select("event_type", "value", (F.quarter("ts") * 1000 + F.col("user_id") % 3).alias("rate"))
    found = rows.groupingSets([["event_type"], ["event_type", "rate"]], "event_type", "rate").agg(q.alias("q"), F.count("value").alias("measured"), F.count("*").alias("clips"))
    return found.select("event_type", "rate", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 50, 90))], "measured", "clips")


@query(
    """WITH c AS (SELECT c_mktsegment AS condition, c_nationkey % 5 AS clip_group, abs(c_acctbal) AS edits, 100.0 AS chars FROM customer), s AS (SELECT condition, sum(edits) / sum(chars) AS cer, sum(edits) FILTER (clip_group < 3) / sum(chars) FILTER (clip_group < 3) AS part FROM c GROUP BY condition)
    SELECT condition, round(cer - (SELECT cer FROM s WHERE condition = 'BUILDING'), 6) AS delta, round(part - (SELECT part FROM s WHERE condition = 'BUILDING'), 6) AS part_delta, abs(cer - (SELECT avg(cer) FROM s)) <= 5 AS tolerable FROM s"""
)
def a34_subset_rescored(spark, sf):
    """Error rates less the floor's, over all rows and scored again over a stated subset; and whether a rate is tolerable."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("condition"), F.abs("c_acctbal").alias("edits"), F.lit(100.0).alias("chars"), (F.col("c_nationkey") % 5 < 3).alias("inside"))
    part = lambda col: F.sum(F.when(F.col("inside"), F.col(col)))
    s = c.groupBy("condition").agg(scores.error_rate(F.col("edits"), F.col("chars")).alias("cer"), (part("edits") / part("chars")).alias("part"))
    # one row each
    floor = s.where("condition = 'BUILDING'").select(F.col("cer").alias("f"), F.col("part").alias("fp")).join(s.agg(F.avg("cer").alias("mean")))
    return s.join(F.broadcast(floor)).select("condition", F.round(F.col("cer") - F.col("f"), 6).alias("delta"), F.round(F.col("part") - F.col("fp"), 6).alias("part_delta"), (F.abs(F.col("cer") - F.col("mean")) <= 5).alias("tolerable"))


def column_score(column: str) -> str:
    own = f"regexp_extract_all(lower({column}), '\\p{{L}}+')"
    listed = ", ".join(map(forms.quoted, text.FUNCTION_WORDS))
    marked = f"sum(length(regexp_replace({column}, '[^{text.MARKED}]', '', 'g'))) / sum(length(regexp_replace({column}, '[^\\p{{L}}]', '', 'g')))"
    closed = f"sum(len(list_filter({own}, lambda w: w IN ({listed})))) / sum(len({own}))"
    return f"CASE WHEN {marked} > 0 THEN 0.6 * least({marked} / 0.08, 1) + 0.4 * least({closed} / 0.30, 1) ELSE 0 END"


CANDIDATES = {"plain": "text", "marked": ORTHOGRAPHY_SQL.format("text"), "code": "CAST(doc_id AS VARCHAR)", "lang_id": ORTHOGRAPHY_SQL.format("text")}


@query(f"WITH c AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CANDIDATES.items())} FROM documents), s AS (SELECT unnest([{{'name': 'plain', 'own': {column_score('plain')}}}, {{'name': 'marked', 'own': {column_score('marked')}}}]) AS s FROM c) SELECT s.name AS name, round(s.own, 6) AS own FROM s WHERE s.own >= {columns.LEAST_SCORE} ORDER BY s.own DESC LIMIT 1")
def c01_chosen_column(spark, sf):
    """Of the plain text, the text in the orthography, a column of numbers and one named as metadata, the second is chosen by its content."""
    rows = docs(spark, sf).select(F.col("text").alias("plain"), in_orthography(F.col("text")).alias("marked"), F.col("doc_id").cast("string").alias("code"), in_orthography(F.col("text")).alias("lang_id"))
    scored = columns.score_columns(rows)
    best = columns.own_column(scored)
    return spark.createDataFrame([(s.name, round(s.own, 6)) for s in scored if s.name == best], "name string, own double")


@query("SELECT DISTINCT n_name AS name, n_nationkey % 4 IN (0, 1) AS own FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'kab_' || n_name WHEN 1 THEN n_name || '_Kabyle' WHEN 2 THEN 'kab' || n_name ELSE n_name END AS n_name FROM nation)")
def c05_own_fields(spark, sf):
    """Names of fields that state the language: a catalogue's names are few, so this is the driver's work."""
    name = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("kab_"), "n_name")).when(F.col("n_nationkey") % 4 == 1, F.concat("n_name", F.lit("_Kabyle"))).when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("kab"), "n_name")).otherwise(F.col("n_name"))
    names = [r[0] for r in table(spark, sf, "nation").select(name).distinct().collect()]
    return spark.createDataFrame([(n, columns.states_language(n)) for n in names], "name string, own boolean")


@query(
    f"""WITH RECURSIVE p AS (SELECT conv_id, turn, {TOKENS(forms.spoken('left_text'))} AS l, {TOKENS(forms.spoken('right_text'))} AS r FROM ({pairs_sql})),
    t AS (SELECT conv_id, turn, l, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda j: CAST(j AS BIGINT)) AS row FROM p
    UNION ALL SELECT conv_id, turn, l, r, i + 1, list_transform(range(0, len(r) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN i + 1 ELSE least(row[k] + CASE WHEN l[i + 1] = r[k] THEN 0 ELSE 1 END, row[k + 1] + 1) - k END))) FROM t WHERE i < len(l))
    SELECT round(sum(row[len(row)]) / sum(len(l)), 6) AS wer FROM t WHERE i = len(l)"""
)
def a11_word_errors(spark, sf):
    rows = pairs(spark, sf).withColumns({"l": normalise.on_texts(labels.spoken)(F.col("left_text")), "r": normalise.on_texts(labels.spoken)(F.col("right_text"))})
    edits = align.word_distance(F.col("l"), F.col("r"))
    return rows.select(edits.alias("edits"), F.size(text.tokens(F.col("l"))).alias("words")).agg(F.round(F.sum("edits") / F.sum("words"), 6).alias("wer"))


SIDES = "SELECT n_chars AS l, n_chars % 97 * 31 + doc_id % 11 AS r, doc_id AS seq FROM documents"


@query(
    f"""WITH RECURSIVE o AS (SELECT l, r, seq, row_number() OVER (ORDER BY seq) AS k FROM ({SIDES})),
    g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs, NULL::BIGINT AS seq
    UNION ALL SELECT o.k, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN NULL ELSE o.seq END FROM g JOIN o ON o.k = g.k + 1)
    SELECT l, r, o.seq FROM g JOIN o ON g.seq = o.seq"""
)
def u08_first_of_either_side(spark, sf):
    rows = docs(spark, sf).select(F.col("n_chars").alias("l"), (F.col("n_chars") % 97 * 31 + F.col("doc_id") % 11).alias("r"), F.col("doc_id").alias("seq"))
    return dedup.either_side_first(rows, "l", "r", "seq")


@query("WITH d AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('seal:' || source), source LIMIT 4) SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM d) THEN 'dev' ELSE 'train' END AS split FROM documents")
def j17_sealed_splits(spark, sf):
    split = splits.by_group(docs(spark, sf).select("doc_id", "source"), "source", 4, "seal")
    return splits.disjoint(split, "source")


STATES = f"list_filter([{FREE_SQL}], lambda x: x IS NOT NULL AND x <> w)"


@query(
    f"""WITH x AS ({LEXICON_SQL}), ix AS (SELECT DISTINCT unnest([form, lower(form)]) AS probe, form, upos FROM x), words AS (SELECT DISTINCT unnest({TOKENS('text')}) AS word FROM documents),
    head AS (SELECT word, lower(word) AS w, CASE WHEN contains(word, '-') AND length(split_part(word, '-', 1)) >= 2 THEN split_part(word, '-', 1) END AS h FROM words),
    tries AS (SELECT DISTINCT word, t.r AS r, t.p AS p FROM (SELECT word, unnest(list_concat([{{'r': 1, 'p': word}}, {{'r': 2, 'p': h}}, {{'r': 3, 'p': w}}, {{'r': 4, 'p': lower(h)}}], list_transform({STATES}, lambda x: {{'r': 5, 'p': x}}))) AS t FROM head) WHERE t.p IS NOT NULL),
    f AS (SELECT word, r, min(r) OVER (PARTITION BY word) AS best FROM tries JOIN ix ON ix.probe = tries.p)
    SELECT {case_routes} AS route, CAST(count(DISTINCT word) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS readings FROM f WHERE r = best GROUP BY 1"""
    if (case_routes := "CASE r " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(lexicon.ROUTES, start=1)) + " END")
    else None
)
def j09_all_routes(spark, sf):
    """All five routes, free states too, over the distinct words."""
    words = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return lexicon.analyse(words, word_list(spark, sf).withColumn("source", F.lit("list"))).groupBy("route").agg(F.countDistinct("word").alias("words"), F.count("*").alias("readings"))


@query("SELECT CAST(sum(length(l.encode()) + 1) AS BIGINT) AS length, sha256(string_agg(l || chr(10), '' ORDER BY item_id)) AS sha256 FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l FROM benchmark)".replace("length(l.encode())", "octet_length(encode(l))"))
def k10_checksums_of_a_file(spark, sf):
    """One file of all items in their order, its size and digest as landed."""
    path = folder(spark, "landed")
    sinks.plain_text(table(spark, sf, "benchmark").orderBy("item_id").coalesce(1), "text", path)
    return sinks.checksums(spark, path).where("path LIKE '%part-%'").select("length", "sha256")


NUMBERS = lambda c: f"list_sort(list_transform(regexp_extract_all(regexp_replace({c}, '{text.PLACEHOLDER}', ' ', 'g'), '\\d[\\d., \\x{{00A0}}\\x{{202F}}]*\\d|\\d'), lambda x: regexp_replace(translate(x, ',. ' || chr(160) || chr(8239), ''), '^0+(.)', '\\1')))"
URLS = lambda c: f"regexp_extract_all({c}, '{text.URL}')"
RATE = lambda c, words: f"(CASE WHEN len(regexp_extract_all(lower({c}), '\\p{{L}}+')) = 0 THEN 0 ELSE len(list_filter(regexp_extract_all(lower({c}), '\\p{{L}}+'), lambda w: w IN ({', '.join(map(forms.quoted, words))}))) / len(regexp_extract_all(lower({c}), '\\p{{L}}+')) END)"
ENGLISH, FRENCH = RATE("right_text", text.ENGLISH), RATE("right_text", text.FRENCH)
LATIN = lambda c: f"(CASE WHEN length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'), '[^\\x{{0000}}-\\x{{024F}}{text.MARKED}]', '', 'g')) / length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) END)"
DEFECTS = f"""CASE WHEN trim(left_text) = '' OR trim(right_text) = '' THEN ['empty'] ELSE list_filter([
    CASE WHEN length(left_text) < 2 OR length(right_text) < 2 THEN 'too-short' END, CASE WHEN length(left_text) > 1000 OR length(right_text) > 1000 THEN 'too-long' END,
    CASE WHEN lower(trim(left_text)) = lower(trim(right_text)) THEN 'untranslated-copy' END,
    CASE WHEN least(len({TOKENS('left_text')}), len({TOKENS('right_text')})) >= 3 AND greatest(length(left_text), length(right_text)) / least(length(left_text), length(right_text)) > 4 THEN 'length-ratio' END,
    CASE WHEN {NUMBERS('left_text')} <> {NUMBERS('right_text')} THEN 'number-mismatch' END, CASE WHEN {URLS('left_text')} <> {URLS('right_text')} THEN 'url-mismatch' END,
    CASE WHEN {LATIN('left_text')} < {text.LATIN_LEAST} THEN 'kab-wrong-script' END, CASE WHEN greatest({ENGLISH}, {FRENCH}) > 0 AND {ENGLISH} < {FRENCH} THEN 'foreign-language-mismatch' END], lambda x: x IS NOT NULL) END"""


@query(f"SELECT conv_id, turn, array_to_string({DEFECTS}, ',') AS defects, len(list_intersect({DEFECTS}, [{', '.join(map(forms.quoted, text.HARD_DEFECTS))}])) > 0 AS hard FROM ({pairs_sql})")
def f03_all_defects(spark, sf):
    """All nine labels of the pairs, the second side being English."""
    found = text.pair_defects(F.col("left_text"), F.col("right_text"), "eng")
    rows = pairs(spark, sf).select("conv_id", "turn", found.alias("d"))
    return rows.select("conv_id", "turn", F.array_join("d", ",").alias("defects"), F.arrays_overlap("d", F.array(*map(F.lit, text.HARD_DEFECTS))).alias("hard"))


@query(f"SELECT name, round(own, 6) AS own FROM (SELECT unnest([{{'name': 'left_text', 'own': {column_score('left_text')}}}, {{'name': 'right_text', 'own': {column_score('right_text')}}}], recursive := true) FROM ({pairs_sql}))")
def c02_column_scores(spark, sf):
    """Both text columns of the pairs, scored in one pass over all rows."""
    scored = columns.score_columns(pairs(spark, sf))
    return spark.createDataFrame([(s.name, round(s.own, 6)) for s in scored if s.name.endswith("_text")], "name string, own double")


@query(
    """WITH names AS (SELECT 'd' || doc_id // 2 || CASE doc_id % 2 WHEN 0 THEN '.kab' ELSE '.eng' END AS name, n_chars FROM documents WHERE doc_id % 7 <> 3)
    SELECT a.stem AS stem, a.n_chars AS own_chars, b.n_chars AS other_chars FROM (SELECT split_part(name, '.', 1) AS stem, n_chars FROM names WHERE name LIKE '%.kab') a JOIN (SELECT split_part(name, '.', 1) AS stem, n_chars FROM names WHERE name LIKE '%.eng') b USING (stem)"""
)
def v11_documents_by_stem(spark, sf):
    """Documents as files in two languages, some of them missing: a pair where both files of a stem are there."""
    name = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".kab").otherwise(".eng"))
    files = docs(spark, sf).where("doc_id % 7 <> 3").select(name.alias("name"), "n_chars")
    side = lambda suffix, n: files.where(F.col("name").endswith(suffix)).select(F.split_part("name", F.lit("."), F.lit(1)).alias("stem"), F.col("n_chars").alias(n))
    return side(".kab", "own_chars").join(side(".eng", "other_chars"), "stem")


def pooled(column: str, words: list[str]) -> str:
    own = f"regexp_extract_all(lower({column}), '\\p{{L}}+')"
    return f"sum(len(list_filter({own}, lambda w: w IN ({', '.join(map(forms.quoted, words))})))) / sum(len({own}))"


def side(column: str) -> str:
    return f"SELECT '{column}' AS name, {column_score(column)} AS own, {pooled(column, text.ENGLISH)} AS english, {pooled(column, text.FRENCH)} AS french FROM ({pairs_sql})"


#: Twins of queries in other modules that state the same as one here.
ORACLES["a11_word_error_rate"] = ORACLES["a11_word_errors"]
ORACLES["j09_full_cascade"] = ORACLES["j09_all_routes"]
ORACLES["j17_disjoint_splits"] = ORACLES["j17_sealed_splits"]
ORACLES["k10_checksums"] = ORACLES["k10_checksums_of_a_file"]
ORACLES["f03_pair_defects"] = f"SELECT conv_id, turn, {DEFECTS} AS defects, len(list_intersect({DEFECTS}, [{', '.join(map(forms.quoted, text.HARD_DEFECTS))}])) > 0 AS hard FROM ({pairs_sql})"
ORACLES["c02_pair_columns"] = f"""SELECT name, round(own, 6) AS own, round(english, 6) AS english, CASE WHEN greatest(english, french) < {columns.LEAST_RATE} THEN 'other' WHEN english >= french * {columns.MARGIN} THEN 'eng' WHEN french >= english * {columns.MARGIN} THEN 'fra' ELSE 'other' END AS language
    FROM ({side('left_text')} UNION ALL {side('right_text')})"""
