"""The catalogue of sources and the append-only records of what was fetched, deferred and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.leaks import bounded

SIZE = T.StructType([T.StructField(n, T.DoubleType() if n == "hours" else T.LongType()) for n in ("rows", "bytes", "sentences", "tokens", "hours", "articles")])
SOURCE = T.StructType(
    [T.StructField(n, T.StringType(), n in ("checksum", "notes")) for n in ("id", "name", "modality", "tier", "access", "uri", "licence")]
    + [T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("size", SIZE), T.StructField("retrieved", T.DateType()), T.StructField("checksum", T.StringType()), T.StructField("notes", T.StringType())]
)
MANIFEST = "source_id string, path string, sha256 string, kind string, target string, bytes long, fetched_at timestamp"
DEFERRAL = "source_id string, reason string, detail string, recorded_at timestamp"
REMOVAL = "source_id string, path string, sha256 string, reason string, removed_at timestamp"

# Redistribution classes of licences (anything else is unclear), and the ranks of classes and tiers.
CLASSES = {
    "permissive": "cc0-1.0 mit apache-2.0 cc-by-2.0 cc-by-3.0 cc-by-4.0 odc-by",
    "share-alike": "cc-by-sa-3.0 cc-by-sa-4.0 gfdl mpl-2.0 odbl",
    "non-commercial": "cc-by-nc-4.0 cc-by-nc-sa-4.0",
}
CLASS_OF = {licence: name for name, licences in CLASSES.items() for licence in licences.split()}
RANK = {"permissive": 0, "share-alike": 1, "unclear": 2, "non-commercial": 3, "none": 4}
TIER_RANK = {"core": 0, "supplementary": 1, "reference": 2, "excluded": 3}
LOCAL_BYTES = 2 * 1024**3
SKIPPED_MODALITIES = ("speech", "tool", "lexicon")


class RegistryError(ValueError):
    """A catalogue that contradicts itself."""


def redistribution(licence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(licence))), F.lit("unclear"))


def load(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The catalogue as a table. Ids are unique, unknown fields and sizes without any count are refused. Small: it may be broadcast."""
    ids = [e.get("id") for e in entries]
    if len(set(ids)) < len(ids):
        raise RegistryError(f"repeated ids: {sorted({i for i in ids if ids.count(i) > 1})}")
    for e in entries:
        extra = set(e) - set(SOURCE.names)
        if extra:
            raise RegistryError(f"{e.get('id')}: unknown fields {sorted(extra)}")
        if not any((e.get("size") or {}).values()):
            raise RegistryError(f"{e.get('id')}: a size needs at least one count")
    rows = [{n: e.get(n) for n in SOURCE.names} for e in entries]
    return spark.createDataFrame(rows, SOURCE).withColumn("redistribution", redistribution(F.col("licence")))


#: A sibling language's source has no tier: what decides about its text is another catalogue.
SIBLING = T.StructType([f for f in SOURCE.fields if f.name != "tier"])


def load_siblings(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The catalogue of sibling languages, as a table of another schema: what takes sources of the corpus cannot take it."""
    for e in entries:
        extra = set(e) - set(SIBLING.names)
        if extra:
            raise RegistryError(f"{e.get('id')}: unknown fields {sorted(extra)}")
    return load(spark, [{**e, "tier": "excluded"} for e in entries]).select(*SIBLING.names, "redistribution")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file; needs a YAML parser on the driver."""
    try:
        import yaml
    except ImportError as missing:
        raise RegistryError("reading YAML needs a YAML parser on the driver") from missing
    with open(path, encoding="utf-8") as handle:
        return load(spark, yaml.safe_load(handle))


def eligible(catalogue: DataFrame, benchmarks: list[str]) -> DataFrame:
    """Sources whose text may enter the corpus, in the order in which first copies win."""
    if "tier" not in catalogue.columns:
        raise RegistryError("these sources have no tier: siblings do not enter the corpus")
    kept = catalogue.where((F.col("tier") != "excluded") & ~F.col("modality").isin(*SKIPPED_MODALITIES) & ~F.col("id").isin(*benchmarks))
    ranked = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    kept = kept.withColumn("priority", F.coalesce(F.try_element_at(ranked(RANK), F.col("redistribution")), F.lit(4)))
    return kept.orderBy("priority", F.coalesce(F.try_element_at(ranked(TIER_RANK), F.col("tier")), F.lit(3)), "id")


def permissive(rows: DataFrame) -> DataFrame:
    return rows.where("redistribution = 'permissive'")


def find(catalogue: DataFrame, tier: str | None = None, modality: str | None = None, language: str | None = None) -> DataFrame:
    """All given predicates must hold; a language also matches its regional codes."""
    if tier:
        catalogue = catalogue.where(F.col("tier") == tier)
    if modality:
        catalogue = catalogue.where(F.col("modality") == modality)
    if language:
        catalogue = catalogue.where(F.exists("languages", lambda x: F.split_part(x, F.lit("_"), F.lit(1)) == language))
    return catalogue


def record(df: DataFrame, path: str, schema: str) -> None:
    """Appends records of what was fetched, deferred or removed to a log; earlier ones are never rewritten."""
    fields = T._parse_datatype_string(schema).names
    missing = set(fields) - set(df.columns)
    if missing:
        raise RegistryError(f"a record lacks {sorted(missing)}")
    df.select(*fields).write.mode("append").json(path)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log's records; a line that is none fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def standing_removals(manifest: DataFrame, removals: DataFrame) -> DataFrame:
    """Removals that no later fetch of the same artifact supersedes."""
    last = manifest.groupBy("source_id", "path").agg(F.max("fetched_at").alias("last"))
    return removals.join(last, ["source_id", "path"], "left").where("last IS NULL OR last <= removed_at").drop("last")


def active_deferrals(manifest: DataFrame, deferrals: DataFrame) -> DataFrame:
    """The newest deferral of each source that has not landed since."""
    newest = deferrals.groupBy("source_id").agg(F.max_by(F.struct("reason", "detail", "recorded_at"), F.struct("recorded_at", "reason")).alias("d")).select("source_id", "d.*")
    landed = manifest.groupBy("source_id").agg(F.max("fetched_at").alias("landed"))
    return newest.join(landed, "source_id", "left").where("landed IS NULL OR landed < recorded_at").drop("landed")


def verify(listing: DataFrame, manifest: DataFrame, removals: DataFrame) -> DataFrame:
    """path and verdict of a disk listing (path, sha256) against the records: ok, missing, mismatch, unrecorded, resurrected."""
    latest = manifest.groupBy("path").agg(F.max_by("sha256", "fetched_at").alias("stated"))
    gone = standing_removals(manifest, removals).select("path", F.lit(True).alias("gone")).distinct()
    both = listing.withColumnRenamed("sha256", "found").join(latest, "path", "full_outer").join(gone, "path", "left")
    on_disk, known, removed = F.col("found").isNotNull(), F.col("stated").isNotNull(), F.coalesce("gone", F.lit(False))
    verdict = (
        F.when(removed & on_disk, "resurrected").when(removed, "removed").when(~on_disk, "missing").when(~known, "unrecorded").when(F.col("found") != F.col("stated"), "mismatch").otherwise("ok")
    )
    return both.select("path", verdict.alias("verdict"))


def placement(tier: Column, modality: Column, path: Column, size: Column) -> Column:
    """Where an artifact goes: nowhere if excluded; sound, scans and what exceeds LOCAL_BYTES to remote storage."""
    heavy = path.rlike(r"(?i)\.(wav|mp3|ogg|flac|opus|m4a|pdf|djvu|epub)$") | ((modality == "speech") & ~path.rlike(r"(?i)\.(tsv|csv|txt|jsonl?|ndjson|ya?ml|md|conllu|xml)$"))
    return F.when(tier == "excluded", "none").when(heavy | (size > LOCAL_BYTES), "remote").otherwise("local")


def compose(stats: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Kept rows and shares by redistribution class; sources without an entry count as unregistered."""
    joined = stats.join(bounded(catalogue.select(F.col("id").alias("source_id"), "redistribution")), "source_id", "left")
    by_class = joined.groupBy(F.coalesce("redistribution", F.lit("unregistered")).alias("redistribution")).agg(F.sum("kept").alias("kept"))
    total = by_class.agg(F.sum("kept").alias("total"))
    return by_class.join(F.broadcast(total)).select("redistribution", "kept", (F.col("kept") / F.col("total")).alias("share"))
