"""Sinks and readers as round trips: rows go out through a sink and come back through a reader. Files stand in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.shared import docs, squeezed
from tessera.session import table
from tessera.sources import landing, readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT conv_id, turn, role, text FROM conversations")
def s02_json_lines(spark, sf):
    """k01 writes, s02 reads; the schema is stated, so nothing is inferred."""
    path = folder(spark, "jsonl")
    sinks.corpus(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    return readers.json_lines(spark, path, "conv_id long, turn long, role string, text string", strict=True)


@query("SELECT n_nationkey, n_name FROM nation")
def s04_delimited(spark, sf):
    path = folder(spark, "tsv")
    table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    found = readers.delimited(spark, path)
    return found.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query(f"SELECT line AS text, CAST(count(*) AS BIGINT) AS n FROM (SELECT {squeezed('text')} AS line FROM documents) WHERE line <> '' GROUP BY line")
def s06_text_lines(spark, sf):
    """k09 writes one squeezed text a line, s06 reads the lines."""
    path = folder(spark, "txt")
    sinks.plain_text(docs(spark, sf), "text", path)
    return readers.lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('fr', 'es') GROUP BY lang")
def k02_partitioned_sink(spark, sf):
    """One folder for each language; a filter on it prunes folders."""
    path = folder(spark, "languages")
    sinks.corpus(docs(spark, sf).select("doc_id", "lang", "n_chars"), path, "parquet", ["lang"])
    return spark.read.parquet(path).where(F.col("lang").isin("fr", "es")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CASE WHEN CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def k05_release(spark, sf):
    path = folder(spark, "release")
    rows = docs(spark, sf).withColumn("split", F.when(text.validation(F.col("text"), 0.1), "validation").otherwise("train"))
    sinks.release(rows, ["text", "lang", "source"], path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) / 4294967296.0 < 0.05 AS validation, CAST(count(*) AS BIGINT) AS texts, CAST(sum(length(text) + 1) AS BIGINT) AS ids FROM documents GROUP BY 1")
def k06_token_stream(spark, sf):
    """Code points stand in for token ids."""
    encode = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    stream = sinks.token_stream(docs(spark, sf), "text", encode, 0, 0.05)
    return stream.groupBy("validation").agg(F.count("*").alias("texts"), F.sum(F.size("ids")).cast("long").alias("ids"))


@query("SELECT p_brand AS piece, CAST(count(*) AS BIGINT) AS score FROM part GROUP BY p_brand")
def k07_seed_pool(spark, sf):
    path = folder(spark, "pool")
    sinks.seed_pool(table(spark, sf, "part").groupBy(F.col("p_brand").alias("piece")).agg(F.count("*").alias("score")), path)
    return readers.exact_width(spark, path, "\t", ["piece", "score"]).select("piece", F.col("score").cast("long").alias("score"))


@query("SELECT 'clip' || s_suppkey AS audio, s_name AS text, s_nationkey AS speaker FROM supplier")
def k08_filelist(spark, sf):
    """k08 writes audio|text|speaker, s29 reads exactly three fields."""
    path = folder(spark, "filelist")
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("clip"), "s_suppkey").alias("audio"), F.col("s_name").alias("text"), F.col("s_nationkey").alias("speaker"))
    sinks.filelist(rows, path)
    return readers.exact_width(spark, path, "|", ["audio", "text", "speaker"]).withColumn("speaker", F.col("speaker").cast("int"))


def landed(spark, rows, name: str, chunk: int):
    """Texts written as files, then fetched from there by ranges: the files' states and the root they landed in."""
    source, root = folder(spark, name), folder(spark, f"{name}-root")
    sinks.plain_text(rows, "text", source)
    files = sinks.checksums(spark, source).where("path LIKE '%part-%'")
    manifest = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("url"), F.col("length").alias("size"), "sha256")
    return landing.land(manifest, root, chunk), root


@query()
def k10_checksums(spark, sf):
    """The items in their order as one file, fetched by ranges of 4 kB: its size and its digest over the chunks."""
    states, _ = landed(spark, table(spark, sf, "benchmark").orderBy("item_id").coalesce(1), "items", 4096)
    return states.where("state = 'complete'").select(F.col("landed").alias("length"), "sha256")


@query(f"SELECT 'complete' AS state, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM (SELECT {squeezed('text')} AS line FROM documents) WHERE line <> ''")
def s33_transfer_states(spark, sf):
    """The documents as files, fetched by ranges of 64 kB and verified: bytes by state."""
    states, _ = landed(spark, docs(spark, sf), "documents", 65_536)
    return states.where("size > 0").groupBy("state").agg(F.sum("landed").alias("bytes"))


@query(f"SELECT line AS text, CAST(count(*) AS BIGINT) AS n FROM (SELECT {squeezed('text')} AS line FROM documents) WHERE line <> '' GROUP BY line")
def s33_landed_lines(spark, sf):
    """Lines of landed files, read from the chunks in parallel; most lines here cross an edge of a chunk of 1,000 bytes."""
    _, root = landed(spark, docs(spark, sf), "lines", 1_000)
    return landing.lines(landing.held(spark, root)).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT l_shipdate, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity > 45 GROUP BY l_shipdate")
def s14_pushed_filters(spark, sf):
    """Both predicates and the two columns reach the Parquet scan."""
    rows = table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1997-01-01 00:00:00' AND l_quantity > 45")
    return rows.groupBy("l_shipdate").agg(F.count("*").alias("n"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 25")
def s32_prefix_by_order(spark, sf):
    """A prefix is only defined by an order: here the limit is the operator."""
    return table(spark, sf, "benchmark").select("item_id", "text").orderBy("item_id").limit(25)
