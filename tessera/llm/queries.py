"""The queries of the training-data operators, over whole tables, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(_docs(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the law `bytes`: the shards' sizes are near equal."""
    from tessera.llm.sharding import assign_shards

    placed = assign_shards(_docs(spark, sf_dir), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import fingerprints

    return fingerprints(_docs(spark, sf_dir))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_crf import train, training_pages, with_main_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = with_main_text(pages, train(training_pages()))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_count import with_token_counts

    return with_token_counts(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "tokens.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled texts outside the held-out quarter, predicts every text."""
    from tessera.llm.langid import held_out, identify, train

    docs = _docs(spark, sf_dir)
    out = held_out(F.col("doc_id"), 4, 2)
    model = train(docs.where(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels outside the held-out fifth, scores every text."""
    from tessera.llm.langid import held_out
    from tessera.llm.quality import train, with_quality

    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return with_quality(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import copies

    return copies(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import with_pii

    found = with_pii(_docs(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neardup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), words=2, percent=80)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 20 against all rows."""
    from tessera.llm.vafile import as_integers, search

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), as_integers().alias("v"))
    return search(rows.where("id % 20 = 0"), rows, k=20)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.filter_audit import audit

    return audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lexical import ranked

    return ranked(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprint": op2_fingerprint,
    "op3_html": op3_html,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_sharding": op9_sharding,
    "op10_minhash": op10_minhash,
    "op11_exact_topk": op11_exact_topk,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical": op13_lexical,
}

#: Near-duplicates by comparing all pairs that share a shingle; least is the least doc_id from which a node can be reached.
ORACLES: dict[str, str] = {
    "op10_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s), g AS (SELECT doc_id, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS least FROM n UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(least) AS component_id, min(least) = n.doc_id AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n""",
    "op11_exact_topk": r"""WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op12_filter_audit": r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
        CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) THEN 1 ELSE 0 END AS c, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS e FROM w),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, [a, b, c, d, e] AS m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
    k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k), o AS (SELECT [x.k, y.k, z.k, u.k, v.k] AS o FROM k x, k y, k z, k u, k v WHERE len(list_distinct([x.k, y.k, z.k, u.k, v.k])) = 5),
    r AS (SELECT part, o, s.k AS step, m[o[s.k]] = 1 AS fails, list_sum([m[i] for i in o[1:s.k]]) > 0 AS dead, list_sum([m[i] for i in o[1:s.k - 1]]) > 0 AS was, list_sum(m) = 1 AS sole, good, toxic FROM m, o, k s),
    g AS (SELECT part, list_aggregate([substr('ABCDE', i, 1) for i in o], 'string_agg', '') AS filter_order, step,
        count_if(NOT coalesce(dead, false)) AS kept, count_if(fails AND NOT coalesce(was, false)) AS removed, count_if(fails AND coalesce(was, false)) AS redundant, count_if(fails AND sole) AS unique_fails,
        count_if(fails AND NOT coalesce(was, false) AND good) AS good_lost, count_if(fails AND NOT coalesce(was, false) AND toxic) AS toxic_lost FROM r GROUP BY part, o, step)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM g""",
    "op13_lexical": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id), s AS (SELECT count(*) AS docs, sum(n) AS len FROM n), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS times, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN df USING (term), s GROUP BY item_id, term, docs, df),
    m AS (SELECT doc_id, 25 + (75 * n * docs) // len AS m FROM n, s),
    r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
