"""Readers of raw corpora. Each gives a DataFrame; what Spark has as a format stays that format, so pruning and pushdown hold.
Zip bundles and treebanks are not splittable by Spark: one task reads one file or sentence block, Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import batches
from tessera.sources import landing

#: Levels of nested records that become dotted columns.
DEPTH = 3


class ReadError(ValueError):
    """A source that no reader can take."""


def flattened(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nested structs as dotted string columns, down to depth; lists, maps and deeper structs are dropped."""

    def walk(fields: list[T.StructField], path: list[str]) -> Iterator[Column]:
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                if len(here) < depth:
                    yield from walk(f.dataType.fields, here)
            elif not isinstance(f.dataType, T.ArrayType | T.MapType | T.BinaryType):
                yield F.col(".".join(f"`{p}`" for p in here)).cast("string").alias(".".join(here))

    return df.select(*walk(df.schema.fields, []))


def parquet(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    return spark.read.option("recursiveFileLookup", recursive).parquet(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """Blank and malformed lines are dropped; strict fails on them instead."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file is one record, or an array of records; an unreadable file gives none."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def has_header(cells: list[str]) -> bool:
    """A header has no cell that looks like a sentence."""
    return not any(" " in c.strip() or len(c) > 40 for c in cells)


def delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Quoting is off and a byte-order mark tolerated; without a header the columns are col0, col1 and so on."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "col0 string")
    cells = head[0][0].lstrip("﻿").split(sep)
    titled = has_header(cells)
    names = [c.strip() or f"col{i}" for i, c in enumerate(cells)] if titled else [f"col{i}" for i in range(len(cells))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).option("quote", "").option("escape", "").option("header", titled).schema(schema).csv(path)


def exact_width(spark: SparkSession, path: str, sep: str, columns: list[str]) -> DataFrame:
    """Lines with exactly these columns; others, short or with surplus separators, are skipped."""
    parts = F.split("value", F.lit("\\Q" + sep + "\\E"))
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(columns))
    return rows.select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def zip_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """One row for each non-blank line of every member with the suffix; a member is read by one task, as a stream."""
    rows = landing.zip_members(spark, path, suffix)
    return rows.select("member", "line", stripped("text").alias("text")).where("text <> ''")


def zip_pairs(spark: SparkSession, path: str, own: str, other: str) -> DataFrame:
    """Line-aligned members of one stem: a row where both sides are non-blank. Unequal line counts fail the job; a member without
    another side makes no rows. Lines are joined by their numbers, so a side of any length is spread over the tasks."""
    rows = landing.zip_members(spark, path, f".{own}", f".{other}")
    dot = F.char_length("member") - F.char_length(F.substring_index("member", ".", -1))
    cut = rows.select("bundle", "line", F.substring("member", F.lit(1), dot).alias("stem"), F.substring_index("member", ".", -1).alias("side"), stripped("text").alias("text"))
    found = cut.groupBy("bundle", "stem", "line").agg(*[F.max(F.when(F.col("side") == s, F.col("text"))).alias(s) for s in (own, other)])
    sides = cut.groupBy("bundle", "stem").agg(F.count_distinct("side").alias("sides"))
    # two rows for each pair of members
    both = found.join(F.broadcast(sides.where("sides = 2").drop("sides")), ["bundle", "stem"])
    message = F.concat("bundle", F.lit(": "), "stem", F.lit(" has sides of different numbers of lines, at line "), F.col("line").cast("string"))
    checked = both.withColumn(own, F.when(F.col(own).isNull() | F.col(other).isNull(), F.raise_error(message).cast("string")).otherwise(F.col(own)))
    return checked.where((F.col(own) != "") & (F.col(other) != "")).select(F.concat("stem", F.lit(own)).alias("member"), "line", own, other)


def stripped(column: str) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def record_pairs(df: DataFrame, own: str, other: str) -> DataFrame:
    return df.select(F.col(own), F.col(other)).dropna()


TREEBANK = "sent_id string, words array<struct<id:int,form:string,lemma:string,upos:string,feats:string>>, tokens array<struct<form:string,first:int,last:int,space_after:boolean>>"


WORD = {"id": pa.int32(), "form": pa.string(), "lemma": pa.string(), "upos": pa.string(), "feats": pa.string()}
TOKEN = {"form": pa.string(), "first": pa.int32(), "last": pa.int32(), "space_after": pa.bool_()}


def parse_block(block: str) -> tuple[str | None, list[tuple], list[tuple]] | None:
    """A sentence of ten tab-separated columns: its syntactic words and its surface tokens, which may span words, as tuples of
    their fields. Empty nodes go."""
    sent_id, words, tokens, covered = None, [], [], 0
    for raw in block.splitlines():
        if raw.startswith("#"):
            if raw[1:].strip().startswith("sent_id"):
                sent_id = raw.partition("=")[2].strip()
            continue
        if not raw.strip():
            continue
        cells = raw.split("\t")
        if len(cells) != 10:
            raise ReadError(f"a treebank row has {len(cells)} columns: {raw!r}")
        spaced = cells[9] == "_" or "SpaceAfter=No" not in cells[9].split("|")
        if "." in cells[0]:
            continue
        if "-" in cells[0]:
            first, last = map(int, cells[0].split("-"))
            if first <= covered or last < first:
                raise ReadError(f"the range {cells[0]} overlaps or is empty")
            tokens.append((cells[1], first, last, spaced))
            covered = last
            continue
        number = int(cells[0])
        if number != len(words) + 1:
            raise ReadError(f"word {number} follows word {len(words)}")
        words.append((number, cells[1], cells[2], cells[3], cells[5]))
        if number > covered:
            tokens.append((cells[1], number, number, spaced))
            covered = number
    if tokens and tokens[-1][2] > len(words):
        raise ReadError("a range ends beyond the last word")
    return (sent_id, words, tokens) if words else None


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of a treebank, split at blank lines by the reader itself."""

    schema = to_arrow_schema(T.StructType.fromDDL(TREEBANK))

    def columns(rows: list[tuple]) -> list[pa.Array]:
        ids, words, tokens = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(ids, pa.string()), batches.lists(words, WORD), batches.lists(tokens, TOKEN)]

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            blocks = batch.column(0)
            # a word's record takes some twenty times its row
            for a, b in batches.stretches(pc.binary_length(blocks).to_pylist()):
                made = columns([r for r in map(parse_block, blocks[a:b].to_pylist()) if r])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return spark.read.option("lineSep", "\n\n").text(path).mapInArrow(read, TREEBANK)


def scoring_positions(sentences: DataFrame, words: bool, corrupt: Callable[[Column], Column] | None = None) -> DataFrame:
    """sent_id, place, form and gold of each position that a tagger must label: syntactic words, or surface tokens, of which
    one that spans several words has no gold. corrupt changes what the tagger reads, never the gold."""
    rows = sentences.select("sent_id", F.inline(positions(words)))
    return rows.withColumn("form", corrupt(F.col("form"))) if corrupt else rows


def positions(words: bool) -> Column:
    """A sentence's positions as an array of place, form and gold. Gold is found before they are rows, so that none carries the
    words of its sentence."""
    if words:
        return F.transform("words", lambda u, i: F.struct(i.alias("place"), u["form"].alias("form"), u["upos"].alias("gold")))
    gold = lambda u: F.when(u["first"] == u["last"], F.get("words", u["first"] - 1)["upos"])
    return F.transform("tokens", lambda u, i: F.struct(i.alias("place"), u["form"].alias("form"), gold(u).alias("gold")))


def treebank_words(sentences: DataFrame) -> DataFrame:
    return sentences.select("sent_id", F.explode("words").alias("w")).select("sent_id", "w.form", "w.lemma", "w.upos")


def mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """Titles and wikitext of a dump's pages, with the XML format of Spark. Blanks, tabs and newlines around them go, other white
    space is theirs; a page without a text makes no row."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", True).option("ignoreSurroundingSpaces", False).schema("title string, revision struct<text:string>").load(path)
    return pages.select(bare(F.col("title")).alias("title"), bare(F.col("revision.text")).alias("text")).where("text <> ''")


def bare(text: Column) -> Column:
    # cutting takes time for each character, so only texts with something to cut are looked through
    ends = reduce(Column.__or__, [end(text, F.lit(c)) for c in " \n\t" for end in (F.startswith, F.endswith)])
    return F.when(ends, F.btrim(text, F.lit(" \n\t"))).otherwise(text)


def hunspell(spark: SparkSession, path: str) -> DataFrame:
    """Entries form/flags with their po:, st: and is: fields; the count on the first line is no entry."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT v RLIKE '^[0-9]+$'")
    fields = lambda tag: F.regexp_extract("v", rf"\b{tag}:(\S+)", 1)
    head = F.split("v", r"\s+")[0]
    return rows.select(
        F.split(head, "/")[0].alias("form"),
        F.get(F.split(head, "/"), 1).alias("flags"),
        *[F.when(fields(t) != "", fields(t)).alias(n) for t, n in (("po", "upos"), ("st", "lemma"), ("is", "feats"))],
    )


def dictionary_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a dictionary site fan out to the headword, its plural and its annexed form."""
    posts = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    plain = F.trim(F.regexp_replace(F.regexp_replace("post_content", "<[^>]*>", " "), r"\s+", " "))
    named = lambda label: F.regexp_extract(plain, rf"(?i)\b{label}\s*[:=]\s*(\p{{L}}[\p{{L}}-]*)", 1)
    forms = F.array(F.struct(F.trim("post_title").alias("form"), F.lit("head").alias("kind")), *[F.struct(named(n).alias("form"), F.lit(n).alias("kind")) for n in ("plural", "annexed")])
    return posts.select(F.trim("post_title").alias("head"), F.inline(F.filter(forms, lambda x: x["form"] != "")))


def clusters(df: DataFrame, id_names: list[str], text_names: list[str]) -> DataFrame:
    """cluster and its texts, from whichever of the named columns there are."""
    chosen = lambda names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns])
    rows = df.select(chosen(id_names).alias("cluster"), chosen(text_names).alias("text")).dropna()
    return rows.groupBy("cluster").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def directed(df: DataFrame, own: str) -> DataFrame:
    """own and other side by the direction src-tgt; a malformed direction fails, blank sides give no row."""
    parts = F.split("direction", "-")
    checked = F.assert_true((F.size(parts) == 2) & F.array_contains(parts, own), F.concat(F.lit("malformed direction: "), F.coalesce("direction", F.lit("null"))))
    first = parts[0] == own
    rows = df.where(checked.isNull()).select(F.when(first, F.col("source")).otherwise(F.col("target")).alias("own"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("other"), F.when(first, parts[1]).otherwise(parts[0]).alias("code"))
    return rows.where("trim(own) <> '' AND trim(other) <> ''")


def speech_rows(spark: SparkSession, path: str, durations: str, columns: list[str]) -> DataFrame:
    """Transcripts with their durations; rows with missing or surplus tabs are dropped, a missing duration stays null."""
    needed = {"client_id", "path", "sentence"}
    if not needed <= set(columns):
        raise ReadError(f"columns missing: {sorted(needed - set(columns))}")
    clips = exact_width(spark, path, "\t", columns).where(F.col("path") != "path")
    lengths = exact_width(spark, durations, "\t", ["path", "duration_ms"]).where("duration_ms RLIKE '^[0-9]+$'")
    return clips.join(lengths.withColumn("duration_ms", F.col("duration_ms").cast("long")), "path", "left")


def splits(spark: SparkSession, root: str, language: str, names: list[str]) -> DataFrame:
    """Benchmark sentences, a JSON Lines file `<root>/<split>/<language>.jsonl` for each split. Ids start anew in each, so the key is
    (split, id). A split that is missing or has no sentence is refused."""
    schema = "id long, text string, domain string, topic string, url string, last_updated string, iso_639_3 string, iso_15924 string"
    found = []
    for name in names:
        path = f"{root}/{name}/{language}.jsonl"
        try:
            rows = json_lines(spark, path, schema, strict=True)
        except AnalysisException as missing:
            raise ReadError(f"split {name} of {language} is not there: {path}") from missing
        if rows.isEmpty():
            raise ReadError(f"split {name} of {language} has no sentence: {path}")
        rest = [F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c not in ("id", "text")]
        found.append(rows.select(F.lit(name).alias("split"), "id", "text", *rest))
    return reduce(DataFrame.unionByName, found)


def pair_rows(df: DataFrame, own: str = "kab", named: str = "") -> DataFrame:
    """own, other and code from either layout: a column for each language, or source and target with their languages. named
    is the file's name, which tells a language that no column states. Rows with a blank side go."""
    text = lambda *names: F.trim(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit("")))
    guess = F.lit("eng" if "eng" in named else "fra")
    if own in df.columns:
        # a layout with both: the row is of the first language that has a text
        code = F.when(text("eng") != "", "eng").otherwise("fra") if "eng" in df.columns else F.lit("fra")
        rows = df.select(text(own).alias("own"), text("eng", "fra").alias("other"), code.alias("code"))
    else:
        source, target = text("src_text", "source"), text("tgt_text", "target")
        source_code, target_code = text("src_lang", "source_lang"), text("tgt_lang", "target_lang")
        first = (source_code == own) | F.lit(own in named)
        told = lambda c: F.when(c == "", guess).otherwise(c)
        rows = df.select(F.when(first, source).otherwise(target).alias("own"), F.when(first, target).otherwise(source).alias("other"), F.when(first, told(target_code)).otherwise(told(source_code)).alias("code"))
    return rows.where("own <> '' AND other <> ''")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """The field `text` of JSON Lines. A line that is no record, or one without the field, fails the job with its file and content."""
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.from_json("value", "text string").alias("r"))
    refused = F.raise_error(F.concat(F.col("file"), F.lit(": no record with a text: "), F.substring("value", 1, 200))).cast("string")
    return rows.select(F.coalesce("r.text", refused).alias("text"))


def column_of(spark: SparkSession, path: str, width: int, index: int) -> DataFrame:
    """One column of the lines that have exactly width columns, quoting off."""
    return exact_width(spark, path, "\t", [f"c{i}" for i in range(width)]).select(F.col(f"c{index}").alias("text"))


#: Fields of a record that can hold the line to be set, the first one that is there.
LINE_FIELDS = ("text", "kab", "text_latn", "text_tfng")


def set_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines for page images from a corpus: a Parquet file's script column, a record's field, or the plain line. A line
    that opens a record and is none goes, rather than raw JSON into the targets."""
    if PurePosixPath(path).suffix.lower() == ".parquet":
        table = spark.read.parquet(path)
        chosen = next((c for c in ("text_tfng", "text_latn") if c in table.columns), table.columns[0])
        found = table.select(F.trim(F.col(chosen).cast("string")).alias("text"))
    else:
        rows = spark.read.text(path).select(F.trim("value").alias("v"))
        record = F.try_parse_json("v")
        fields = [F.try_variant_get(record, f"$.{f}", "string") for f in LINE_FIELDS]
        found = rows.select(F.trim(F.when(~F.col("v").startswith("{"), F.col("v")).when(record.isNotNull(), F.coalesce(*fields, "v"))).alias("text"))
    return found.where("text <> ''")


def book_pages(spark: SparkSession, root: str) -> DataFrame:
    """Books as folders with `crops/page_<n>.png`, and the text of a page where the book's pages.jsonl has it. Only names
    are read of the images."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.png").load(root)
    images = found.select(F.col("_metadata.file_path").alias("path"))
    # paths come as addresses, with their blanks encoded
    book = lambda path, tail: F.url_decode(F.replace(F.regexp_extract(path, rf"([^/]+)/{tail}$", 1), F.lit("+"), F.lit("%2B")))
    pages = images.select("path", book("path", r"crops/page_[^/]*").alias("book"), F.regexp_extract("path", r"_([0-9]+)\.png$", 1).cast("int").alias("page")).where("book <> ''")
    lines_ = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "pages.jsonl").text(root)
    stated = lines_.select(book(F.col("_metadata.file_path"), "pages.jsonl").alias("book"), F.from_json("value", "page_number int, text string").alias("r")).where("r.page_number IS NOT NULL")
    known = stated.groupBy("book", F.col("r.page_number").alias("page")).agg(F.max("r.text").alias("text"))
    return pages.join(known, ["book", "page"], "left").select("book", "page", "path", "text")


def filelist(spark: SparkSession, path: str) -> DataFrame:
    """audio|text|speaker. A line of another width, or with a blank audio or speaker, fails the job."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", parts.alias("p"))
    whole = (F.size("p") == 3) & (F.get("p", 0) != "") & (F.get("p", 2) != "")
    refused = F.raise_error(F.concat(F.lit("a filelist's line lacks a field: "), F.col("value"))).cast("string")
    return rows.select(F.when(whole, F.get("p", 0)).otherwise(refused).alias("audio"), F.get("p", 1).alias("text"), F.get("p", 2).alias("speaker"))


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a path's extension."""
    suffix = PurePosixPath(path).suffix.lower()
    known = {
        ".parquet": parquet,
        ".jsonl": json_lines,
        ".json": json_document,
        ".tsv": delimited,
        ".csv": lambda s, p: delimited(s, p, ","),
        ".txt": lines,
        ".zip": lambda s, p: zip_lines(s, p, ".kab"),
        ".conllu": treebank,
        ".xml": mediawiki,
        ".bz2": mediawiki,
    }
    if suffix not in known:
        raise ReadError(f"no reader for {path!r}")
    return known[suffix](spark, path)
