"""Analysis of word forms against a lexicon: a cascade of probes, and the vote of the best tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clitic_head, free_candidates
from tessera.operators.dedup import first_copies

ROUTES = ("exact", "clitic", "casefold", "casefold-clitic", "state")


def merge(entries: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One entry for each form, lemma, class and features: that of the source with the lowest priority number."""
    feats = F.array_join(F.transform(F.array_sort(F.map_entries("feats")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair]), F.col("source")), F.lit(1_000))
    return first_copies(entries.withColumn("_feats", feats).withColumn("_priority", rank), ["form", "lemma", "upos", "_feats"], ["_priority", "source"]).drop("_feats", "_priority")


def analyse(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """All readings of each distinct word from the first route that has any: word, route, and the lexicon's columns.

    Entries are also found under their lower-cased form. Distinct words are probed, so a frequent word costs one row."""
    index = lexicon.select("*", F.explode(F.array_distinct(F.array("form", F.lower("form")))).alias("probe"))
    low = F.lower("word")
    tries = [F.array("word"), F.array(clitic_head(F.col("word"))), F.array(low), F.array(clitic_head(low)), free_candidates(low)]
    probes = [F.transform(t, _with_route(r)) for r, t in enumerate(tries)]
    words = forms.select("word").where("word <> ''").distinct()
    tried = words.select("word", F.inline(F.concat(*probes))).where("probe IS NOT NULL").distinct()
    found = tried.join(index, "probe")
    first = found.withColumn("_first", F.min("route").over(Window.partitionBy("word"))).where("route = _first")
    return first.withColumn("route", F.element_at(F.array(*map(F.lit, ROUTES)), F.col("route") + 1)).drop("_first", "probe")


def _with_route(route: int):
    return lambda p: F.struct(F.lit(route).alias("route"), p.alias("probe"))


def vote(readings: DataFrame, tier: dict[str, int]) -> DataFrame:
    """The word class that most readings of the best tier give; a tie, or no class, gives null."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in tier.items() for x in pair]), F.col("source")), F.lit(1_000))
    ranked = readings.withColumn("_tier", rank).where("upos IS NOT NULL")
    best = ranked.withColumn("_best", F.min("_tier").over(Window.partitionBy("word"))).where("_tier = _best")
    counts = best.groupBy("word", "upos").agg(F.count("*").alias("n"))
    top = counts.withColumn("_rank", F.rank().over(Window.partitionBy("word").orderBy(F.desc("n")))).where("_rank = 1")
    winners = top.groupBy("word").agg(F.when(F.count("*") == 1, F.min("upos")).alias("upos"))
    return readings.select("word").distinct().join(winners, "word", "left")
