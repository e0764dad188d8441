"""Joins, set operations, deduplication, windows, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import dedup, leaks, packing, scores, splits
from tessera.plans import whole
from tessera.plans.hygiene import sql_key
from tessera.plans.shared import TOKENS, WORDS, docs, pairs, pairs_sql
from tessera.plans.texts import SENTENCES_SQL
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


KEY_SQL = "trim(regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g'))"


def keyed(df, column="text"):
    return df.withColumn("key", sql_key(F.col(column)))


@query(whole.ORACLES["j01_whole_blocklist"])
def j01_benchmark_blocklist(spark, sf):
    """Whole texts and every line against whole items and their lines."""
    return whole.j01_whole_blocklist(spark, sf)


def GRAMS(name: str, k: int = 8) -> str:
    return f"""SELECT DISTINCT {name}, unnest(list_transform(range(1, len(t) - {k - 2}), lambda i: array_to_string(t[i:i + {k - 1}], ' '))) AS gram"""


J02 = f"""d AS ({GRAMS("doc_id")} FROM (SELECT doc_id, {TOKENS("lower(text)")} AS t FROM documents)),
    b AS ({GRAMS("item_id")} FROM (SELECT item_id, {TOKENS("lower(text)")} AS t FROM benchmark)),
    m AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (gram) GROUP BY ALL)"""


@query(f"WITH {J02} SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared FROM m")
def j02_ngram_leaks(spark, sf):
    return leaks.ngram_matches(docs(spark, sf), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query(f"WITH {J02} SELECT item_id, min(doc_id) AS doc_id FROM m GROUP BY item_id")
def j02_first_credit(spark, sf):
    """Each leaked item is credited to its least document: a stated order instead of iteration order."""
    return leaks.ngram_matches(docs(spark, sf), table(spark, sf, "benchmark"), "doc_id", "item_id").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {J02} SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM benchmark), 6) AS leak_rate FROM m")
def a05_leak_rate(spark, sf):
    bench = table(spark, sf, "benchmark")
    hit = leaks.ngram_matches(docs(spark, sf), bench, "doc_id", "item_id").select("item_id").distinct().withColumn("hit", F.lit(1))
    return bench.join(hit, "item_id", "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("leak_rate"))


@query(f"SELECT conv_id, turn FROM ({pairs_sql}) WHERE {KEY_SQL.format('left_text')} NOT IN (SELECT {KEY_SQL.format('text')} FROM conversations WHERE role = 'system') AND {KEY_SQL.format('right_text')} NOT IN (SELECT {KEY_SQL.format('text')} FROM conversations WHERE role = 'system')")
def j03_two_sided_exclusion(spark, sf):
    both = pairs(spark, sf).withColumns({"l": sql_key(F.col("left_text")), "r": sql_key(F.col("right_text"))})
    blocked = keyed(table(spark, sf, "conversations").where("role = 'system'"))
    return leaks.without(both, blocked, ["l", "r"], "key").select("conv_id", "turn")


@query(
    f"""WITH g AS (SELECT conv_id, turn, {KEY_SQL.format('text')} AS key FROM conversations),
    bad AS (SELECT DISTINCT conv_id FROM g WHERE key IN (SELECT {KEY_SQL.format('text')} FROM documents)),
    ok AS (SELECT * FROM g WHERE conv_id NOT IN (SELECT conv_id FROM bad))
    SELECT a.conv_id AS conv_id, a.turn AS turn_a, b.turn AS turn_b FROM ok a JOIN ok b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.key <> b.key"""
)
def j04_cluster_pairs(spark, sf):
    """A conversation stands for a cluster: one blocked member drops it whole; the others pair i < j, equal texts apart."""
    rows = keyed(table(spark, sf, "conversations")).select("conv_id", "turn", "key")
    ok = leaks.whole_groups_without(rows, keyed(docs(spark, sf)), "conv_id", "key", "key")
    a, b = (ok.select("conv_id", F.col("turn").alias(f"turn_{s}"), F.col("key").alias(f"key_{s}")) for s in "ab")
    return a.join(b, "conv_id").where("turn_a < turn_b AND key_a <> key_b").select("conv_id", "turn_a", "turn_b")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'only_a' WHEN b.k IS NOT NULL THEN 'only_b' ELSE 'neither' END AS stratum,
    CAST(count(*) AS BIGINT) AS n FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_custkey = b.k GROUP BY 1"""
)
def j05_filter_agreement(spark, sf):
    orders = table(spark, sf, "orders")
    member = lambda test, name: orders.where(test).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn(name, F.lit(True))
    tagged = table(spark, sf, "customer").join(member("o_orderpriority = '1-URGENT'", "a"), "c_custkey", "left").join(member("o_orderstatus = 'F'", "b"), "c_custkey", "left")
    stratum = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither")
    return tagged.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))


@query(
    f"""WITH k AS (SELECT doc_id, lang, {KEY_SQL.format('text')} AS key FROM documents), e AS (SELECT * FROM k WHERE lang = 'de')
    SELECT CASE WHEN key IN (SELECT key FROM k WHERE lang <> 'de') THEN 'in_corpus' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1"""
)
def j06_counted_exclusions(spark, sf):
    rows = keyed(docs(spark, sf)).select("doc_id", "lang", "key")
    corpus = rows.where("lang <> 'de'").select("key").distinct().withColumn("hit", F.lit(True))
    marked = rows.where("lang = 'de'").join(corpus, "key", "left")
    return marked.groupBy(F.when(F.col("hit"), "in_corpus").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT user_id, min_by(event_id, event_id) AS first_view FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id),
    b AS (SELECT user_id, min(event_id) AS first_other FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id)
    SELECT user_id, first_view, first_other FROM a FULL OUTER JOIN b USING (user_id)"""
)
def j07_outer_merge(spark, sf):
    """Two keyed maps, the first value of each key, merged on the union of keys."""
    events = table(spark, sf, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    tagged = events.join(F.broadcast(ends))
    side = lambda on, name: tagged.where(F.col("event_type") == F.col(on)).groupBy("user_id").agg(F.min("event_id").alias(name))
    return side("lo", "first_view").join(side("hi", "first_other"), "user_id", "full_outer")


@query(
    """WITH t AS (SELECT l_orderkey AS k, sum(l_quantity) FILTER (l_returnflag = 'A') AS one, sum(l_quantity) FILTER (l_returnflag = 'R') AS two FROM lineitem GROUP BY 1)
    SELECT k AS orderkey, CASE WHEN one IS NOT NULL AND two IS NOT NULL THEN CASE WHEN least(one, two) / greatest(one, two) >= 0.5 THEN two END ELSE coalesce(one, two) END AS chosen FROM t
    WHERE one IS NOT NULL OR two IS NOT NULL"""
)
def j08_two_teachers(spark, sf):
    """Both present: the second if they agree enough, else none; one alone is kept."""
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(flag("A").alias("one"), flag("R").alias("two"))
    agree = F.least("one", "two") / F.greatest("one", "two") >= 0.5
    both = F.col("one").isNotNull() & F.col("two").isNotNull()
    return t.where("one IS NOT NULL OR two IS NOT NULL").select("orderkey", F.when(both, F.when(agree, F.col("two"))).otherwise(F.coalesce("one", "two")).alias("chosen"))


LEXICON_SQL = f"SELECT w AS form, CASE length(w) % 3 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' ELSE 'ADP' END AS upos FROM (SELECT unnest({WORDS}) AS w FROM documents WHERE lang = 'en') GROUP BY w HAVING count(*) >= 5"


def lexicon(spark, sf):
    """Words that the English documents use five times or more, with a made-up class: stands in for a lexicon."""
    counts = docs(spark, sf).where("lang = 'en'").select(F.explode(text.words(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    upos = F.when(F.char_length("form") % 3 == 0, "NOUN").when(F.char_length("form") % 3 == 1, "VERB").otherwise("ADP")
    return counts.where("n >= 5").select("form", upos.alias("upos"))


PROBE_SQL = f"""x AS ({LEXICON_SQL}), w AS (SELECT DISTINCT unnest({TOKENS('text')}) AS word FROM documents),
    p AS (SELECT word, unnest([{{'r': 0, 'f': word}}, {{'r': 1, 'f': CASE WHEN contains(word, '-') AND length(split_part(word, '-', 1)) >= 2 THEN split_part(word, '-', 1) END}}, {{'r': 2, 'f': lower(word)}}]) AS p FROM w)"""


@query(f"WITH {PROBE_SQL} SELECT word, min(p.r) AS route FROM p JOIN x ON x.form = p.f GROUP BY word")
def j09_probe_cascade(spark, sf):
    """Exact, clitic head, lower case: the first probe with a reading wins."""
    words = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    probes = words.select("word", F.posexplode(F.array("word", text.clitic_head(F.col("word")), F.lower("word"))).alias("route", "form"))
    return probes.join(lexicon(spark, sf), "form").groupBy("word").agg(F.min("route").alias("route"))


@query("SELECT CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'found' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, 1 AS o_orderkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY 1")
def j10_lookup(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("found", F.lit(True))
    return table(spark, sf, "customer").join(known, "c_custkey", "left").groupBy(F.when(F.col("found"), "found").otherwise("missing").alias("verdict")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT source, lang FROM documents) SELECT a.lang AS split_a, b.lang AS split_b, CAST(count(*) AS BIGINT) AS shared FROM s a JOIN s b ON a.source = b.source AND a.lang < b.lang GROUP BY ALL")
def j11_speaker_overlap(spark, sf):
    s = docs(spark, sf).select("source", "lang").distinct()
    a, b = s.select("source", F.col("lang").alias("split_a")), s.select("source", F.col("lang").alias("split_b"))
    return a.join(b, "source").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_nationkey < 3 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 3")
def j12_restricted_union(spark, sf):
    chosen = table(spark, sf, "nation").where("n_nationkey < 3").select("n_nationkey")
    part = lambda name, p: table(spark, sf, name).join(F.broadcast(chosen), F.col(f"{p}_nationkey") == F.col("n_nationkey"), "left_semi")
    s = part("supplier", "s").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = part("customer", "c").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c)


@query("SELECT r_name, CAST(count(n_nationkey) AS BIGINT) AS nations, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def j13_stats_by_catalogue(spark, sf):
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    joined = joined.join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.count("s_suppkey").alias("suppliers"))


@query(
    f"""WITH k AS (SELECT doc_id, source, {KEY_SQL.format('text')} AS key FROM documents), seen AS (SELECT DISTINCT key FROM k WHERE source = 'src1'),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k WHERE source <> 'src1')
    SELECT CASE WHEN key IN (SELECT key FROM seen) THEN 'seen' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1"""
)
def j14_prompt_exclusions(spark, sf):
    rows = keyed(docs(spark, sf)).select("doc_id", "source", "key")
    seen = rows.where("source = 'src1'").select("key").distinct().withColumn("seen", F.lit(True))
    ranked = rows.where("source <> 'src1'").withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).join(seen, "key", "left")
    return ranked.groupBy(F.when(F.col("seen"), "seen").when(F.col("rn") > 1, "duplicate").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


J15 = """f AS (SELECT user_id, max(ts) AS fetched FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id),
    r AS (SELECT user_id, max(ts) AS removed FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id)"""


@query(f"WITH {J15} SELECT user_id, removed FROM r LEFT JOIN f USING (user_id) WHERE fetched IS NULL OR fetched <= removed")
def j15_standing_removals(spark, sf):
    """A removal stands unless a later fetch exists."""
    events = table(spark, sf, "events")
    last = lambda test, name: events.where(test).groupBy("user_id").agg(F.max("ts").alias(name))
    both = last("event_type NOT IN ('click', 'view')", "removed").join(last("event_type IN ('click', 'view')", "fetched"), "user_id", "left")
    return both.where("fetched IS NULL OR fetched <= removed").select("user_id", "removed")


@query(
    """WITH d AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_nationkey < 20)
    SELECT CASE WHEN d.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unrecorded' WHEN d.n <> m.n THEN 'mismatch' ELSE 'ok' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM d FULL OUTER JOIN m ON d.k = m.k GROUP BY 1"""
)
def j16_listing_against_manifest(spark, sf):
    listing = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("found"))
    manifest = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("stated"))
    both = listing.join(manifest, "k", "full_outer")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("stated").isNull(), "unrecorded").when(F.col("found") != F.col("stated"), "mismatch").otherwise("ok")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query()
def j17_disjoint_splits(spark, sf):
    """By-group splits pass the refusal of keys in two splits."""
    split = splits.by_group(docs(spark, sf).select("doc_id", "source"), "source", 4, "seal")
    return splits.disjoint(split, "source")


@query(
    f"""WITH k AS (SELECT doc_id, n_chars, {KEY_SQL.format('text')} AS key FROM documents WHERE n_chars >= 100),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM k WHERE key NOT IN (SELECT {KEY_SQL.format('text')} FROM benchmark))
    SELECT doc_id FROM r WHERE rn = 1 ORDER BY doc_id LIMIT 20"""
)
def j18_ordered_selection(spark, sf):
    """The first twenty that survive exclusion and deduplication: the limit is the operator."""
    rows = keyed(docs(spark, sf).where("n_chars >= 100")).select("doc_id", "key")
    ok = leaks.without(rows, keyed(table(spark, sf, "benchmark")), ["key"], "key")
    return dedup.first_copies(ok, ["key"], ["doc_id"]).orderBy("doc_id").limit(20).select("doc_id")


LINES = "list_filter(string_split({}, chr(10)), lambda x: trim(x) <> '')"


@query(
    f"""WITH p AS (SELECT conv_id, turn, {LINES.format('left_text')} AS l, {LINES.format('right_text')} AS r FROM ({pairs_sql}))
    SELECT conv_id, turn, CAST(least(len(l), len(r)) AS BIGINT) AS paired, CAST(abs(len(l) - len(r)) AS BIGINT) AS surplus FROM p"""
)
def j19_line_alignment(spark, sf):
    own = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    left, right = own("left_text"), own("right_text")
    return pairs(spark, sf).select("conv_id", "turn", F.least(left, right).cast("long").alias("paired"), F.abs(left - right).cast("long").alias("surplus"))


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, lang FROM documents UNION ALL SELECT 'benchmark', NULL FROM benchmark UNION ALL SELECT 'conversations', NULL FROM conversations) GROUP BY ALL")
def u01_union(spark, sf):
    none = F.lit(None).cast("string")
    parts = [docs(spark, sf).select("source", "lang")] + [table(spark, sf, t).select(F.lit(t).alias("source"), none.alias("lang")) for t in ("benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def u02_distinct_keys(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u03_difference(spark, sf):
    """Customers without an urgent order."""
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def u04_intersection(spark, sf):
    d = docs(spark, sf)
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'fr'").select("source"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(left_text)), lower(trim(right_text)) ORDER BY conv_id, turn) AS rn FROM ({pairs_sql})), k AS (SELECT * FROM r WHERE rn = 1)
    SELECT conv_id, turn, 'ab' AS direction, left_text AS source, right_text AS target FROM k UNION ALL SELECT conv_id, turn, 'ba', right_text, left_text FROM k"""
)
def u05_pairs_both_directions(spark, sf):
    sides = pairs(spark, sf).withColumns({"l": F.lower(F.trim("left_text")), "r": F.lower(F.trim("right_text"))})
    kept = dedup.first_copies(sides, ["l", "r"], ["conv_id", "turn"])
    way = lambda d, a, b: F.struct(F.lit(d).alias("direction"), F.col(a).alias("source"), F.col(b).alias("target"))
    return kept.select("conv_id", "turn", F.inline(F.array(way("ab", "left_text", "right_text"), way("ba", "right_text", "left_text"))))


@query(f"SELECT DISTINCT unnest({WORDS}) AS word FROM documents")
def u06_word_union(spark, sf):
    return docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).distinct()


@query("SELECT DISTINCT c AS symbol FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND NOT regexp_matches(c, '[a-zA-Z ]')")
def u07_unsupported_symbols(spark, sf):
    chars = docs(spark, sf).select(F.explode(F.array_distinct(F.split("text", ""))).alias("symbol")).distinct()
    return chars.where((F.col("symbol") != "") & ~F.col("symbol").rlike("[a-zA-Z ]"))


@query()
def u08_either_side(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return dedup.either_side_first(rows, "l_partkey", "l_suppkey", "seq")


@query(
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {KEY_SQL.format('text')} ORDER BY CAST(substr(source, 4) AS INTEGER) % 4, source, doc_id) AS rn FROM documents) WHERE rn = 1"""
)
def w01_first_copy_wins(spark, sf):
    """The release rank is simulated by the source's number; source and doc_id make the order total."""
    rank = F.substring("source", 4, 9).cast("int") % 4
    return dedup.first_copies(keyed(docs(spark, sf)), ["key"], [rank, "source", "doc_id"]).select("doc_id", "source")


@query("SELECT c_custkey, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -2)) + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -2)) - 1) / 2 AS rank FROM customer")
def w02_average_rank(spark, sf):
    rows = table(spark, sf, "customer").withColumn("v", F.round("c_acctbal", -2))
    return scores.average_ranks(rows, ["c_mktsegment"], "v").select("c_custkey", "c_mktsegment", F.col("v_rank").alias("rank"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_linestatus) + (count(*) OVER (PARTITION BY l_linestatus) - 1) / 2 AS by_status, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS by_price FROM lineitem")
def w02_rank_of_all(spark, sf):
    """Ranks of all rows as one group, by a string of few values and a number of many."""
    ranked = scores.average_ranks(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_extendedprice"), [], "l_linestatus", "l_extendedprice")
    return ranked.select("l_orderkey", "l_linenumber", F.col("l_linestatus_rank").alias("by_status"), F.col("l_extendedprice_rank").alias("by_price"))


FREQ = f"SELECT w, count(*) AS n FROM (SELECT unnest({TOKENS('text')}) AS w FROM documents) GROUP BY w"


@query(
    f"""WITH f AS ({FREQ}), r AS (SELECT row_number() OVER (ORDER BY n DESC, w) AS rank, sum(n) OVER (ORDER BY n DESC, w ROWS UNBOUNDED PRECEDING) / (SELECT sum(n) FROM f) AS share FROM f)
    SELECT rank, round(share, 6) AS share FROM r WHERE rank IN (10, 100, 500)"""
)
def w03_coverage_curve(spark, sf):
    """The ranks asked for bound the rows that are ordered: a top-k first, then the running sum over it."""
    freq = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = freq.orderBy(F.desc("n"), "w").limit(500)
    order = Window.orderBy(F.desc("n"), "w")
    total = freq.agg(F.sum("n").alias("total"))
    ranked = top.withColumns({"rank": F.row_number().over(order).cast("long"), "running": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.join(F.broadcast(total)).where(F.col("rank").isin(10, 100, 500)).select("rank", F.round(F.col("running") / F.col("total"), 6).alias("share"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('cap:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 2 ORDER BY md5('cap:' || doc_id), doc_id LIMIT 25")
def w04_capped_then_limited(spark, sf):
    order = splits.draw_order(F.col("doc_id"), "cap")
    capped = dedup.first_per_group(docs(spark, sf).select("doc_id", "source"), ["source"], [order, "doc_id"], 2)
    return capped.orderBy(order, "doc_id").limit(25)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7")
def w05_first_of_each_group(spark, sf):
    return dedup.first_per_group(docs(spark, sf).select("doc_id", "lang"), ["lang"], ["doc_id"], 7)


VOTES = "SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL"


@query(f"WITH v AS ({VOTES}), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM v) SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS winner FROM r WHERE r = 1 GROUP BY user_id")
def w06_vote_with_ties(spark, sf):
    """The value with most votes; a tie gives null."""
    votes = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = votes.withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("n")))).where("r = 1")
    return top.groupBy("user_id").agg(F.when(F.count("*") == 1, F.min("event_type")).alias("winner"))


@query(f"WITH v AS ({VOTES}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM v) SELECT user_id, event_type, CAST(n AS BIGINT) AS n FROM r WHERE r = 1")
def w07_most_frequent_value(spark, sf):
    return dedup.most_frequent(table(spark, sf, "events"), ["user_id"], "event_type")


@query(
    f"""WITH t AS (SELECT lang, unnest({WORDS}) AS w FROM documents), c AS (SELECT w, lang, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT w, lang FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, lang) AS r FROM c) WHERE r = 1)
    SELECT t.lang AS lang, round(avg(CAST(m.lang = t.lang AS INTEGER)), 6) AS accuracy FROM t JOIN m USING (w) GROUP BY t.lang"""
)
def w08_most_frequent_tag(spark, sf):
    """Every word gets its most frequent tag; scored on the tokens. Counts, not tokens, are joined."""
    tokens = docs(spark, sf).select("lang", F.explode(text.words(F.col("text"))).alias("w"))
    counts = tokens.groupBy("w", "lang").agg(F.count("*").alias("n"))
    best = dedup.first_copies(counts, ["w"], [F.desc("n"), "lang"]).select("w", F.col("lang").alias("best"))
    hit = F.sum(F.when(F.col("best") == F.col("lang"), F.col("n")).otherwise(0))
    return counts.join(best, "w").groupBy("lang").agg(F.round(hit / F.sum("n"), 6).alias("accuracy"))


@query("SELECT conv_id, turn, role, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) > length(text), false) AS grows FROM conversations")
def w10_next_row(spark, sf):
    n = F.char_length("text")
    nxt = F.lead(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(nxt > n, F.lit(False)).alias("grows"))


@query("SELECT p_type, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_brand, p_partkey) AS rn FROM part) WHERE rn = 1")
def w11_merge_by_priority(spark, sf):
    return dedup.first_copies(table(spark, sf, "part"), ["p_type", "p_size"], ["p_brand", "p_partkey"]).select("p_type", "p_size", "p_partkey")


@query(
    """WITH e AS (SELECT source, doc_id, n_chars, sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e, sum(n_chars + 1) OVER (PARTITION BY source) AS total FROM documents)
    SELECT source, doc_id, CAST(floor((e - n_chars - 1) / 1024) AS BIGINT) AS first_block, CAST(floor((e - 1) / 1024) AS BIGINT) AS last_block, e > floor(total / 1024) * 1024 AS in_tail FROM e"""
)
def w12_document_blocks(spark, sf):
    return packing.blocks(docs(spark, sf), "source", "doc_id", "n_chars", 1024)


@query(
    """WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY source), b AS (SELECT max(b) AS b FROM range(1, (SELECT CAST(sum(c) // 6 + 1 AS BIGINT) FROM c)) t(b) WHERE (SELECT sum(least(c, b)) FROM c) >= 6 * b),
    k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('batch:' || doc_id), doc_id) AS k FROM documents),
    p AS (SELECT doc_id, source, b, row_number() OVER (ORDER BY md5('batch:' || source), source, k) - 1 AS p FROM k, b WHERE k <= b)
    SELECT doc_id, source, CAST(p % b AS BIGINT) AS batch, CAST(p // b AS BIGINT) AS slot FROM p WHERE p // b < 6"""
)
def w13_distinct_cluster_batches(spark, sf):
    """As many full batches of six documents of different sources as there can be."""
    return packing.distinct_cluster_batches(docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 6)


@query(
    """WITH c AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), b AS (SELECT greatest(max(c), CAST(ceil(sum(c) / 3) AS BIGINT)) AS b FROM c),
    p AS (SELECT doc_id, lang, b, row_number() OVER (ORDER BY md5('batch:' || lang), lang, md5('batch:' || doc_id), doc_id) - 1 AS p FROM documents, b) SELECT doc_id, lang, CAST(p % b AS BIGINT) AS batch, CAST(p // b AS BIGINT) AS slot FROM p"""
)
def w13_all_rows_in_batches(spark, sf):
    """All documents in batches of three languages at most, of which some stay short."""
    return packing.distinct_cluster_batches(docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 3, full=False)


@query("SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents")
def w14_length_batches(spark, sf):
    return packing.length_batches(docs(spark, sf).select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id", 16).select("doc_id", "lang", "batch")


@query("SELECT doc_id FROM documents ORDER BY md5('draw:' || doc_id), doc_id LIMIT 50")
def t01_uniform_sample(spark, sf):
    return splits.sample(docs(spark, sf).select("doc_id"), "doc_id", 50, "draw")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('even:' || event_id), event_id) AS rn FROM events) WHERE rn <= 10")
def t02_balanced_sample(spark, sf):
    return splits.balanced(table(spark, sf, "events").select("event_id", "event_type"), "event_type", "event_id", 10, "even")


@query(f"WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS line FROM documents) SELECT line, min(doc_id) AS doc_id FROM s GROUP BY line")
def t03_distinct_candidates(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(text.sentences(F.col("text"))).alias("line")).groupBy("line").agg(F.min("doc_id").alias("doc_id"))


@query(
    """WITH g AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('hold:' || conv_id), conv_id LIMIT 5)
    SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM g) THEN 'dev' ELSE 'train' END AS split FROM conversations"""
)
def t04_cluster_split(spark, sf):
    return splits.by_group(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", 5, "hold")


@query(
    f"""WITH p AS (SELECT *, md5(left_text || chr(9) || right_text) AS pair FROM ({pairs_sql})), g AS (SELECT pair FROM (SELECT DISTINCT pair FROM p) ORDER BY md5('pair:' || pair), pair LIMIT 8)
    SELECT conv_id, turn, direction, CASE WHEN pair IN (SELECT pair FROM g) THEN 'dev' ELSE 'train' END AS split FROM p, (VALUES ('ab'), ('ba')) d(direction)"""
)
def t05_pair_split(spark, sf):
    """Both directions of a pair go the same way."""
    both = pairs(spark, sf).withColumn("pair", F.md5(F.concat("left_text", F.lit("\t"), "right_text"))).withColumn("direction", F.explode(F.array(F.lit("ab"), F.lit("ba"))))
    return splits.by_group(both, "pair", 8, "pair").select("conv_id", "turn", "direction", "split")


@query(
    """WITH k AS (SELECT source, row_number() OVER (ORDER BY md5('ratio:' || source), source) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
    SELECT source, CASE WHEN place < floor(n * 0.8) THEN 'train' WHEN place < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split FROM k"""
)
def t06_ratio_split(spark, sf):
    return splits.by_ratio(docs(spark, sf), "source", "ratio")


@query(
    """WITH c AS (SELECT doc_id FROM documents WHERE n_chars >= 2000 ORDER BY md5('cycle:' || doc_id), doc_id LIMIT 20),
    d AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c) ORDER BY md5('dev:' || doc_id), doc_id LIMIT 30)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM c) THEN 'cycle' WHEN doc_id IN (SELECT doc_id FROM d) THEN 'dev' ELSE 'train' END AS split FROM documents"""
)
def t07_fixed_draws(spark, sf):
    rows = docs(spark, sf).select("doc_id", "n_chars")
    cycle = splits.sample(rows.where("n_chars >= 2000"), "doc_id", 20, "cycle").select("doc_id").withColumn("cycle", F.lit(True))
    marked = rows.join(F.broadcast(cycle), "doc_id", "left")
    dev = splits.sample(marked.where("cycle IS NULL"), "doc_id", 30, "dev").select("doc_id").withColumn("dev", F.lit(True))
    return marked.join(F.broadcast(dev), "doc_id", "left").select("doc_id", F.when(F.col("cycle"), "cycle").when(F.col("dev"), "dev").otherwise("train").alias("split"))


@query("SELECT l_suppkey, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS middle, CAST(count(*) FILTER (l_quantity >= 40) AS BIGINT) AS large FROM lineitem GROUP BY l_suppkey ORDER BY total DESC, l_suppkey LIMIT 5")
def t08_top_k(spark, sf):
    q = F.col("l_quantity")
    stats = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(q).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.median(q).alias("middle"), F.count_if(q >= 40).alias("large"))
    return stats.orderBy(F.desc("total"), "l_suppkey").limit(5)


@query(f"WITH x AS ({LEXICON_SQL}), w AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w) SELECT w AS word, CAST(n AS BIGINT) AS n FROM w WHERE w NOT IN (SELECT form FROM x) ORDER BY n DESC, w LIMIT 30")
def t09_top_unknown(spark, sf):
    counts = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = lexicon(spark, sf).select(F.col("form").alias("word"))
    return counts.join(known, "word", "left_anti").orderBy(F.desc("n"), "word").limit(30)


@query(f"WITH w AS (SELECT unnest({TOKENS('text')}) AS w FROM documents), p AS (SELECT unnest(string_split(w, '-')[2:]) AS piece FROM w WHERE contains(w, '-')) SELECT piece, CAST(count(*) AS BIGINT) AS n FROM p WHERE piece <> '' GROUP BY piece ORDER BY n DESC, piece LIMIT 20")
def t10_top_clitics(spark, sf):
    words = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("w")).where(F.col("w").contains("-"))
    parts = F.split("w", "-")
    pieces = words.select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("piece")).where("piece <> ''")
    return pieces.groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(20)


@query(
    f"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w HAVING count(*) >= 2), p AS (SELECT w AS piece, n, n * length(w) AS score FROM w ORDER BY score DESC, w LIMIT 40)
    SELECT piece, CAST(score AS BIGINT) AS score FROM p UNION ALL SELECT form, CAST(1 AS BIGINT) FROM ({LEXICON_SQL}) WHERE length(form) >= 12 AND form NOT IN (SELECT piece FROM p)"""
)
def t11_seed_pool(spark, sf):
    """The best by count times length, then the lexical pieces that are not among them."""
    counts = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n")).where("n >= 2")
    pool = counts.select("piece", (F.col("n") * F.char_length("piece")).alias("score")).orderBy(F.desc("score"), "piece").limit(40)
    forced = lexicon(spark, sf).where(F.char_length("form") >= 12).select(F.col("form").alias("piece"), F.lit(1).cast("long").alias("score"))
    return pool.unionByName(forced.join(F.broadcast(pool.select("piece")), "piece", "left_anti"))


@query(f"SELECT w AS word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def t12_common_words(spark, sf):
    counts = docs(spark, sf).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(100)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3")
def t13_head_rows(spark, sf):
    return dedup.first_per_group(docs(spark, sf).select("source", "doc_id"), ["source"], ["doc_id"], 3)


@query("SELECT item_id FROM (SELECT item_id FROM benchmark ORDER BY md5('shots:' || item_id), item_id LIMIT 5)")
def t14_few_shots(spark, sf):
    return splits.sample(table(spark, sf, "benchmark").select("item_id"), "item_id", 5, "shots").orderBy("item_id")


@query("SELECT item_id, row_number() OVER (ORDER BY md5('mix:' || item_id), item_id) AS place FROM benchmark")
def t15_permutation(spark, sf):
    return splits.placed(table(spark, sf, "benchmark").select("item_id"), "item_id", "mix").select("item_id", (F.col("_place") + 1).alias("place"))


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY md5('mix:' || doc_id), doc_id LIMIT 30)
    UNION ALL SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY md5('mix:' || doc_id), doc_id LIMIT 10)"""
)
def t16_two_pool_mix(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang")
    return splits.sample(d.where("lang = 'en'"), "doc_id", 30, "mix").unionByName(splits.sample(d.where("lang = 'fr'"), "doc_id", 10, "mix"))


