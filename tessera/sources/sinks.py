"""Sinks: Spark's commit protocol makes an output appear only when it is whole; refusals are checked before writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import landing


class SinkError(ValueError):
    """An output that must not be published."""


def corpus(df: DataFrame, path: str, form: str = "json", by: list[str] | None = None) -> None:
    """One commit; by gives a folder for each value, as for languages and splits."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def non_empty(df: DataFrame, path: str, form: str = "parquet") -> None:
    if df.isEmpty():
        raise SinkError(f"no rows for {path}")
    corpus(df, path, form)


def lexicon(entries: DataFrame, priority: dict[str, int], path: str) -> None:
    """Merged entries in one commit; no entry at all is refused."""
    from tessera.operators.lexicon import merge

    non_empty(merge(entries, priority), path)


def splits(df: DataFrame, path: str, names: list[str], key: str | None = None, split: str = "split", form: str = "json") -> dict[str, int]:
    """A folder for each split, and the rows of each. A split without rows, an unnamed one, or a key in two is refused."""
    counts = {r[split]: r["count"] for r in df.groupBy(split).count().collect()}
    if set(counts) != set(names):
        raise SinkError(f"splits {sorted(map(str, counts))}, not {sorted(names)}")
    if key and not df.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").isEmpty():
        raise SinkError(f"a {key} stands in two splits")
    corpus(df, path, form, [split])
    return counts


def release(df: DataFrame, columns: list[str], path: str, split: str = "split") -> None:
    """The declared columns, missing ones as nulls; refused if a column is null in every row."""
    shaped = df.select(split, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    counts = shaped.agg(*[F.count(c).alias(c) for c in columns]).first()
    bare = [c for c in columns if not counts[c]]
    if bare:
        raise SinkError(f"null in every row: {bare}")
    corpus(shaped, path, "parquet", [split])


def plain_text(df: DataFrame, column: str, path: str) -> None:
    """One line for each text, white space squeezed."""
    df.select(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def seed_pool(df: DataFrame, path: str) -> None:
    """piece TAB score; an empty pool is refused."""
    if df.isEmpty():
        raise SinkError("the seed pool is empty")
    df.select(F.concat_ws("\t", "piece", F.col("score").cast("string"))).write.mode("overwrite").text(path)


def filelist(df: DataFrame, path: str) -> None:
    """audio|text|speaker; empty lists, blank fields, bars in fields and speakers that are no integers are refused."""
    bad = F.count_if(
        (F.trim(F.coalesce("audio", F.lit(""))) == "") | ~F.coalesce(F.col("speaker").cast("string"), F.lit("")).rlike("^[0-9]+$") | F.coalesce(F.col("text"), F.lit("|")).contains("|")
    )
    row = df.agg(F.count("*").alias("n"), bad.alias("bad")).first()
    if not row["n"] or row["bad"]:
        raise SinkError(f"{row['bad']} of {row['n']} rows can't be listed")
    df.select(F.concat_ws("|", "audio", "text", "speaker")).write.mode("overwrite").text(path)


def zip_pairs(df: DataFrame, stem: str, own: str, other: str, path: str) -> None:
    """Line-aligned members <stem>.<own> and <stem>.<other> of the pairs, in an archive from each task; readers.zip_pairs reads the
    folder. A missing side is a blank line. Lines hold no line break: a side that does fails the job."""
    df.sparkSession.dataSource.register(landing.ZipMembers)
    text = lambda side: F.when(F.contains(side, F.lit("\n")), F.raise_error(F.concat(F.lit("a line break in a line: "), F.substring(side, 1, 200))).cast("string")).otherwise(F.coalesce(side, F.lit("")))
    line = lambda side: F.struct(F.concat(F.col(stem), F.lit(f".{side}")).alias("member"), "line", text(F.col(side)).alias("text"))
    # numbered where they are written, so that both sides of a task have one order
    rows = df.select(stem, own, other, F.monotonically_increasing_id().alias("line")).select(F.inline(F.array(line(own), line(other))))
    rows.sortWithinPartitions("member", "line").select("member", "text").write.format("zip_members").mode("append").save(path)


def checksums(spark, path: str) -> DataFrame:
    """Path, size and SHA-256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def token_stream(df: DataFrame, text: str, encode, separator: int, share: float) -> DataFrame:
    """ids of each text with a closing separator, and whether its hash routes it to validation. encode maps a column to ids."""
    from tessera.functions.text import validation

    return df.select(F.concat(encode(F.col(text)), F.array(F.lit(separator))).alias("ids"), validation(F.col(text), share).alias("validation"))
