"""Clip measures against plain sums, a plain Fourier transform and signals whose answer is known; pages against their lines."""

from __future__ import annotations

import math
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import acoustics, raster
from tessera.plans import catalogue

RATE = 8_000


def measured(spark, clips):
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(clips)]
    df = spark.createDataFrame(rows, "i int, x array<double>").select("i", "x", acoustics.clip_measures(F.col("x")).alias("c"), acoustics.speech_measures(F.col("x"), RATE).alias("s"))
    return [r.asDict(True) for r in df.withColumn("f", acoustics.spectral_measures(F.col("x"), F.col("s.levels"), F.col("s.speech"), RATE)).orderBy("i").collect()]


def test_levels_and_speech_of_clips(spark):
    rng = np.random.default_rng(1)
    talk = rng.normal(0, 0.2, RATE)
    clip = np.concatenate([rng.normal(0, 0.001, RATE // 2), talk, rng.normal(0, 0.001, RATE // 4)])
    clip[100:105] = 1.0
    clip[200:202] = -1.0
    got = measured(spark, [clip, np.zeros(RATE), [0.5], []])
    first = got[0]
    assert first["c"]["peak"] == 1.0 and first["c"]["clipped_runs"] == 1
    assert first["c"]["clipped_share"] == pytest.approx(5 / len(clip))
    assert first["c"]["rms_dbfs"] == pytest.approx(10 * math.log10((clip**2).mean()))
    length, hop = acoustics.frame_sizes(RATE)
    levels = [10 * math.log10(max((clip[s : s + length] ** 2).mean(), 1e-12)) for s in range(0, len(clip) - length + 1, hop)]
    assert first["s"]["levels"] == pytest.approx(levels)
    low, high = np.percentile(levels, [10, 95])
    speech = [v >= max(low + 20, high - 35) for v in levels]
    assert list(first["s"]["speech"]) == speech
    assert first["s"]["lead_ms"] == pytest.approx(10.0 * speech.index(True))
    assert first["s"]["floor_dbfs"] == pytest.approx(low)
    # digital silence has no floor and no speech that stands over it is told; a clip shorter than a frame has no frames
    assert got[1]["c"]["rms_dbfs"] is None and got[1]["s"]["floor_dbfs"] is None
    assert got[2]["s"] is None and got[2]["f"]["rolloff_hz"] is None and got[3]["c"] is None


def test_spectrum_is_that_of_a_plain_transform():
    rng = np.random.default_rng(2)
    x = rng.normal(size=1000)
    speech = np.array([True, False, True, True, False, True])
    length, hop = acoustics.frame_sizes(RATE)
    angles = np.exp(-2j * np.pi * np.outer(np.arange(length // 2 + 1), np.arange(length)) / length)
    fade = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / (length - 1))
    want = np.mean([np.abs(angles @ (x[k * hop : k * hop + length] * fade)) ** 2 for k in np.flatnonzero(speech)], axis=0)
    assert acoustics.speech_spectrum(x, speech, RATE) == pytest.approx(want)


def test_a_band_that_ends_is_found():
    rng = np.random.default_rng(3)
    rate, length = 24_000, acoustics.frame_sizes(24_000)[0]
    freq = np.fft.rfftfreq(24_000, 1 / rate)
    spectrum = np.fft.rfft(rng.normal(0, 0.1, 24_000))
    narrow = np.fft.irfft(np.where(freq < 5_000, spectrum, spectrum * 1e-4))
    whole = np.fft.irfft(spectrum)
    every = np.ones((24_000 - length) // acoustics.frame_sizes(rate)[1] + 1, dtype=bool)
    rolloff, top, edge = acoustics.band(acoustics.speech_spectrum(narrow, every, rate), rate, length)
    assert 4_700 < rolloff < 5_100 and top < -50 and abs(edge - 5_000) < 500
    rolloff, top, edge = acoustics.band(acoustics.speech_spectrum(whole, every, rate), rate, length)
    assert rolloff > 11_500 and top > -10 and edge is None


def test_decay_of_a_known_slope():
    step = 0.01
    fall = -200.0  # dB a second
    levels = np.concatenate([np.full(20, -20.0), -20 + fall * step * np.arange(1, 20), np.full(20, -90.0)] * 2)
    speech = levels >= -22
    seconds, ends = acoustics.decay(levels, speech, RATE)
    assert ends == 2 and seconds == pytest.approx(60 / 200, rel=0.1)
    assert acoustics.decay(np.full(50, -20.0), np.ones(50, bool), RATE) == (None, 0)
    assert acoustics.decay(levels[:3], speech[:3], RATE) == (None, 0)


def test_pages_are_cut_into_their_lines(spark):
    texts = ["one line here\nand another one\n\nthe last of them", "x", "", "\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", raster.line_crops(raster.set_pages(F.col("t"))).alias("c")).collect()}
    assert [(c["top"], c["bottom"]) for c in got[0]] == [(6, 34), (36, 64), (96, 124)]
    page = raster.set_page(texts[0].split("\n"))
    assert all((raster.read(bytes(c["image"])) == page[c["top"] : c["bottom"]]).all() for c in got[0])
    # one character is too little ink for a line: the page stays whole, and so does an empty one
    assert [(c["top"], c["bottom"]) for c in got[1]] == [(0, 40)] and len(got[2]) == len(got[3]) == 1 and got[4] is None
    thin = np.full((100, 50), 255, np.uint8)
    thin[10:20] = 0  # too low
    thin[40:60] = 0
    thin[90:] = 0
    assert raster.crops(thin) == [(36, 64)] and raster.crops(thin, least=10) == [(6, 24), (36, 64), (86, 100)]
    with pytest.raises(ValueError):
        raster.read(b"P6 1 1 255 x")


def test_whole_texts_are_set_and_cut(spark, tmp_path):
    texts = ["x" * 61, "ab " * 1_000, "y" * 6_001 + "\n\n" + "short line\n" + "\U0001f600é" * 95, "", "\n", "z", "a\u00a0b\x0bc\td\r", " " * 200 + "end of it", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["v26_line_crops"]).fetchall()
    got = sorted(tuple(r) for r in catalogue.queries()["v26_line_crops"](spark, str(tmp_path)).select("doc_id", "top", "bottom", "ink").collect())
    assert got == sorted(want)
    # every character that is no white space has 80 pixels in some line
    ink = {i: sum(r[3] for r in got if r[0] == i) for i in range(len(texts) - 1)}
    assert [ink[i] for i in range(4)] == [80 * n for n in (61, 2_000, 6_001 + 9 + 190, 0)]


def test_lines_of_a_text_are_those_of_its_page():
    rng = np.random.default_rng(4)
    for _ in range(20):
        text = "".join(rng.choice(list("ab \n"), rng.integers(0, 4_000), p=[0.5, 0.3, 0.19, 0.01]))
        page = raster.set_page(text.split("\n"))
        assert raster.lines_set(text) == [(a, b, int((page[a:b] < raster.INK).sum())) for a, b in raster.crops(page)]
        assert sum(ink for _, _, ink in raster.lines_set(text)) <= 80 * len("".join(text.split()))


def test_a_page_of_a_long_text_takes_little_memory():
    tracemalloc.start()
    lines = raster.lines_set("word " * 100_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the page has 90 MB
    assert sum(ink for _, _, ink in lines) == 80 * 400_000 and most < 40 << 20
