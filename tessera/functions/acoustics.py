"""Measures of sound clips given as arrays of samples at their own rate. Levels, silence and clipping are column expressions;
the spectrum and the decay after speech are taken by numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

# Frames, gates and limits of the measures.
FRAME_MS, HOP_MS = 25.0, 10.0
GATE_DB, SPEECH_RANGE_DB, NOISE_PERCENTILE = 20.0, 35.0, 10.0
ROLLOFF_SHARE = 0.99
EDGE_SPAN_HZ, EDGE_DROP_DB, SMOOTH_HZ = 500.0, 30.0, 100.0
CLIP_LEVEL, MIN_CLIP_RUN = 0.99, 3
DECAY_WINDOW_MS, MIN_DECAY_DB, MIN_DECAY_FRAMES, DECAY_DEPTH_DB = 200.0, 10.0, 4, 30.0
EPSILON, CLAMP_DB = 1e-12, -119.0


def frame_sizes(rate: int) -> tuple[int, int]:
    """Samples of a frame, and from one frame to the next."""
    return max(round(FRAME_MS / 1000 * rate), 2), max(round(HOP_MS / 1000 * rate), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def decibels(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(EPSILON)))


def powers(samples: Column, rate: int) -> Column:
    """The mean square of each frame; none of a clip that is shorter than one."""
    length, hop = frame_sizes(rate)
    last = F.size(samples) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: total(F.transform(F.slice(samples, s + 1, length), lambda v: v * v)) / length)


def quantile(ordered: Column, q: float) -> Column:
    """Between the two nearest values of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    value, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return value + (at - low) * (above - value)


def clip_measures(samples: Column) -> Column:
    """peak, rms_dbfs (null for digital silence), dc_offset, clipped_runs and clipped_share of the samples in runs at full scale."""
    n = F.size(samples)
    power = total(F.transform(samples, lambda v: v * v)) / n
    hot = F.array_join(F.transform(samples, lambda v: F.when(F.abs(v) >= CLIP_LEVEL, "1").otherwise("0")), "")
    runs = F.regexp_extract_all(hot, F.lit("1{%d,}" % MIN_CLIP_RUN), 0)
    measured = F.struct(
        F.array_max(F.transform(samples, lambda v: F.abs(v))).alias("peak"),
        F.when(power > EPSILON, 10 * F.log10(power)).alias("rms_dbfs"),
        (total(samples) / n).alias("dc_offset"),
        F.size(runs).alias("clipped_runs"),
        (F.char_length(F.array_join(runs, "")) / n).alias("clipped_share"),
    )
    return F.when(n > 0, measured)


def speech_measures(samples: Column, rate: int) -> Column:
    """What the frames tell: floor_dbfs (null where the silence is digital zero), speech_dbfs, speech_to_floor_db, the share of
    frames with speech, silence before and after in ms, and the levels and the speech of each frame. Speech is what stands
    above a gate over the floor, and not too far below the loudest frames. Null without a frame."""
    hop_ms = frame_sizes(rate)[1] / rate * 1000

    def told(power: Column, levels: Column, low: Column, high: Column) -> Column:
        speech = F.transform(levels, lambda x: x >= F.greatest(low + GATE_DB, high - SPEECH_RANGE_DB))
        places = F.filter(F.transform(speech, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())
        active = F.filter(F.zip_with(power, speech, lambda p, s: F.when(s, p)), lambda p: p.isNotNull())
        level = F.when(F.size(active) > 0, decibels(total(active) / F.size(active)))
        real = (low > CLAMP_DB) & level.isNotNull()
        return F.struct(
            F.when(real, low).alias("floor_dbfs"), level.alias("speech_dbfs"), F.when(real, level - low).alias("speech_to_floor_db"),
            (F.size(active) / F.size(levels)).alias("speech_share"), (F.array_min(places) * hop_ms).alias("lead_ms"),
            ((F.size(levels) - 1 - F.array_max(places)) * hop_ms).alias("trail_ms"), levels.alias("levels"), speech.alias("speech"),
        )

    leveled = lambda p: let(F.transform(p, decibels), lambda v: let(F.sort_array(v), lambda o: told(p, v, quantile(o, NOISE_PERCENTILE / 100), quantile(o, 0.95))))
    return let(powers(samples, rate), lambda p: F.when(F.size(p) > 0, leveled(p)))


def band(power: np.ndarray, rate: int, length: int) -> tuple[float, float, float | None]:
    """The frequency below which nearly all energy lies, the upper half of the band against the peak in dB, and the highest
    frequency from which the smoothed spectrum falls steeply, if it does."""
    width = rate / length
    held = np.cumsum(power)
    rolloff = min(int(np.searchsorted(held, ROLLOFF_SHARE * held[-1])), len(power) - 1) * width
    level = lambda p: 10 * np.log10(np.maximum(p, EPSILON))
    top = float(level(power[len(power) // 2 :].mean()) - level(power.max()))
    smooth, span = (max(round(hz / width), 1) for hz in (SMOOTH_HZ, EDGE_SPAN_HZ))
    sums = np.concatenate([[0.0], np.cumsum(level(power))])
    even = (sums[smooth:] - sums[:-smooth]) / smooth
    falls = np.flatnonzero(even[:-span] - even[span:] >= EDGE_DROP_DB) if len(even) > span else []
    return float(rolloff), top, float((falls[-1] + (smooth - 1) / 2) * width) if len(falls) else None


def speech_spectrum(samples: np.ndarray, speech: np.ndarray, rate: int) -> np.ndarray:
    """The mean power spectrum of the frames with speech, each faded in and out."""
    length, hop = frame_sizes(rate)
    at = np.flatnonzero(speech)[:, None] * hop + np.arange(length)
    return (np.abs(np.fft.rfft(samples[at] * np.hanning(length), axis=1)) ** 2).mean(axis=0)


def decay(levels: np.ndarray, speech: np.ndarray, rate: int) -> tuple[float | None, int]:
    """Seconds that the sound would take to fall by 60 dB, from the median slope after speech ends, and how many ends tell.

    An end counts from its last frame with speech until the level has fallen by DECAY_DEPTH_DB or the window is over, if it
    falls by MIN_DECAY_DB over MIN_DECAY_FRAMES."""
    if len(speech) < MIN_DECAY_FRAMES:
        return None, 0
    step = frame_sizes(rate)[1] / rate
    window = max(round(DECAY_WINDOW_MS / 1000 / step), MIN_DECAY_FRAMES)
    slopes = []
    for end in np.flatnonzero(speech[:-1] & ~speech[1:]):
        tail = levels[end : end + window]
        deep = tail <= tail[0] - DECAY_DEPTH_DB
        tail = tail[: int(deep.argmax()) + 1] if deep.any() else tail
        if len(tail) >= MIN_DECAY_FRAMES and tail[0] - tail[-1] >= MIN_DECAY_DB:
            t = (np.arange(len(tail)) - (len(tail) - 1) / 2) * step
            slopes.append(float((t * tail).sum() / (t * t).sum()))
    falling = [s for s in slopes if s < 0]
    return (60 / abs(float(np.median(falling))), len(falling)) if falling else (None, 0)


def spectral_measures(samples: Column, levels: Column, speech: Column, rate: int) -> Column:
    """rolloff_hz, top_octave_db, band_edge_hz, decay_s and decay_ends; nulls without speech."""

    def batch(x: pd.Series, v: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows = []
        for own, level, talks in zip(x, v, s, strict=True):
            if talks is None or not np.any(talks):
                rows.append((None, None, None, None, 0))
                continue
            rows.append((*band(speech_spectrum(np.asarray(own, dtype=float), np.asarray(talks), rate), rate, frame_sizes(rate)[0]), *decay(np.asarray(level), np.asarray(talks), rate)))
        frame = pd.DataFrame(rows, columns=["rolloff_hz", "top_octave_db", "band_edge_hz", "decay_s", "decay_ends"])
        return frame.astype({c: "float64" for c in frame.columns[:-1]}).astype({"decay_ends": "int32"})

    return F.pandas_udf(batch, "rolloff_hz double, top_octave_db double, band_edge_hz double, decay_s double, decay_ends int")(samples, levels, speech)
