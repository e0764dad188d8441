"""Sound clips strung together from the embeddings, and pages set from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import acoustics, raster
from tessera.plans.shared import docs
from tessera.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Samples a second, vectors of a clip, and what makes their components loud enough to clip.
RATE, VECTORS, GAIN = 8_000, 50, 4


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def clips(spark, sf):
    """(clip, samples): each fifty vectors in a row, every second ten of them as silence, cut off at full scale."""
    e = table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / VECTORS).alias("clip"), F.col("embedding").cast("array<double>").alias("v"))
    loud = F.when(F.floor(F.col("vec_id") / 10) % 2 == 0, F.transform("v", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * GAIN)))).otherwise(F.transform("v", lambda x: x / 1000))
    parts = e.select("clip", F.struct("vec_id", loud.alias("x")).alias("p")).groupBy("clip").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("clip", F.flatten(F.col("p.x")).alias("x"))


CLIPS_SQL = f"""c AS (SELECT vec_id // {VECTORS} AS clip, flatten(list(CASE WHEN vec_id // 10 % 2 = 0 THEN list_transform(embedding, lambda v: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE * {GAIN}))) ELSE list_transform(embedding, lambda v: v::DOUBLE / 1000) END ORDER BY vec_id)) AS x FROM embeddings GROUP BY ALL)"""
LENGTH, HOP = acoustics.frame_sizes(RATE)


@query(
    f"""WITH {CLIPS_SQL}, h AS (SELECT clip, x, regexp_extract_all(array_to_string(list_transform(x, lambda v: CASE WHEN abs(v) >= {acoustics.CLIP_LEVEL} THEN '1' ELSE '0' END), ''), '1{{{acoustics.MIN_CLIP_RUN},}}') AS runs FROM c)
    SELECT clip, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, round(10 * log10(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 3) AS rms_dbfs, round(list_sum(x) / len(x), 6) AS dc_offset,
    CAST(len(runs) AS INTEGER) AS clipped_runs, round(length(array_to_string(runs, '')) / len(x), 6) AS clipped_share FROM h"""
)
def m19_levels(spark, sf):
    """Peak, level, offset and clipping of each clip."""
    m = clips(spark, sf).select("clip", acoustics.clip_measures(F.col("x")).alias("m"))
    digits = {"peak": 6, "rms_dbfs": 3, "dc_offset": 6, "clipped_share": 6}
    return m.select("clip", "m.clipped_runs", *[F.round(f"m.{c}", d).alias(c) for c, d in digits.items()])


@query(
    f"""WITH {CLIPS_SQL}, p AS (SELECT clip, list_transform(range(0, len(x) - {LENGTH} + 1, {HOP}), lambda s: list_sum(list_transform(x[s + 1:s + {LENGTH}], lambda v: v * v)) / {LENGTH}) AS p FROM c WHERE len(x) >= {LENGTH}),
    l AS (SELECT clip, p, list_transform(p, lambda v: 10 * log10(greatest(v, {acoustics.EPSILON}))) AS l FROM p),
    g AS (SELECT *, list_aggregate(l, 'quantile_cont', 0.1) AS low, greatest(list_aggregate(l, 'quantile_cont', 0.1) + {acoustics.GATE_DB}, list_aggregate(l, 'quantile_cont', 0.95) - {acoustics.SPEECH_RANGE_DB}) AS gate FROM l),
    s AS (SELECT *, list_filter(range(0, len(l)), lambda i: l[i + 1] >= gate) AS speech FROM g), t AS (SELECT *, 10 * log10(list_avg(list_transform(speech, lambda i: p[i + 1]))) AS active FROM s)
    SELECT clip, round(low, 3) AS floor_dbfs, round(active, 3) AS speech_dbfs, round(active - low, 3) AS speech_to_floor_db, round(len(speech) / len(l), 6) AS speech_share, round(speech[1] * {HOP} / {RATE} * 1000, 3) AS lead_ms, round((len(l) - 1 - speech[-1]) * {HOP} / {RATE} * 1000, 3) AS trail_ms FROM t"""
)
def m19_speech(spark, sf):
    """Floor, speech and silence of each clip by frames of 25 ms."""
    m = clips(spark, sf).select("clip", acoustics.speech_measures(F.col("x"), RATE).alias("m")).where("m IS NOT NULL")
    digits = {"floor_dbfs": 3, "speech_dbfs": 3, "speech_to_floor_db": 3, "speech_share": 6, "lead_ms": 3, "trail_ms": 3}
    return m.select("clip", *[F.round(f"m.{c}", d).alias(c) for c, d in digits.items()])


@query()
def m19_spectrum(spark, sf):
    """Rolloff, upper octave, band edge and decay of each clip, and the quantiles of a summary are A29's."""
    m = clips(spark, sf).select("clip", "x", acoustics.speech_measures(F.col("x"), RATE).alias("m"))
    return m.select("clip", acoustics.spectral_measures(F.col("x"), F.col("m.levels"), F.col("m.speech"), RATE).alias("s")).select("clip", "s.*")


#: A text's lines, each cut evenly into as many as it takes for 60 characters at most.
SET_SQL = """flatten(list_transform(string_split(text, chr(10)), lambda x: list_transform(range(greatest(1, (length(x) + 59) // 60)),
    lambda i: x[i * length(x) // greatest(1, (length(x) + 59) // 60) + 1:(i + 1) * length(x) // greatest(1, (length(x) + 59) // 60)])))"""


@query(f"""WITH l AS (SELECT doc_id, unnest({SET_SQL}) AS line, generate_subscripts({SET_SQL}, 1) - 1 AS place FROM documents),
    i AS (SELECT doc_id, place, length(regexp_replace(line, '\\s', '', 'g')) AS ink, count(*) OVER (PARTITION BY doc_id) AS lines FROM l),
    k AS (SELECT doc_id, place * 30 + 6 AS top, place * 30 + 34 AS bottom, ink FROM i WHERE ink * 4 > 0.015 * 360)
    SELECT doc_id, CAST(top AS INTEGER) AS top, CAST(bottom AS INTEGER) AS bottom, CAST(ink * 80 AS BIGINT) AS ink FROM k
    UNION ALL SELECT doc_id, 0, CAST(10 + 30 * max(lines) AS INTEGER), CAST(sum(ink) * 80 AS BIGINT) FROM i WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id""")
def v26_line_crops(spark, sf):
    """Documents set as page images, whole, and cut back into their lines: where each lies and how many of its pixels are ink."""
    return docs(spark, sf).select("doc_id", F.inline(raster.set_lines(F.col("text")))).select("doc_id", "top", "bottom", "ink")
