"""Clip tables: ``clips(job_id, seg_idx, sr, samples array<float>)`` and frames of them.

What SQL can say stays native; spectra, pitch and filters run in numpy on Arrow batches, one clip
at a time, so a task never holds more than a batch of clips.  Joining and what is measured on joined
audio take a job's clips one after the other and hold what the next one needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechprep.functions.values import dbfs, expected_seconds, fresh, semitones
from speechprep.operators.quantiles import percentiles
from speechprep.sources.shared import checkpointed

CLIP = "job_id string, seg_idx int, sr int, samples array<float>"


# frames


def frames(clips: DataFrame, size_ms: float, hop_ms: float, inclusive: bool = True) -> DataFrame:
    """``(job_id, seg_idx, frame_idx, samples)``; the last full frame is left out unless ``inclusive``."""
    size, hop = F.floor(F.col("sr") * size_ms / 1000).cast("int"), F.greatest(F.floor(F.col("sr") * hop_ms / 1000).cast("int"), F.lit(1))
    last = F.size("samples") - size - (0 if inclusive else 1)
    cut = clips.withColumn("start", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last, hop)).otherwise(F.array().cast("array<int>"))))
    return cut.select("job_id", "seg_idx", F.floor(F.col("start") / hop).cast("int").alias("frame_idx"), F.slice("samples", F.col("start") + 1, size).alias("samples"))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def frame_rms(fr: DataFrame) -> DataFrame:
    return fr.select("job_id", "seg_idx", "frame_idx", rms(F.col("samples")).alias("rms"))


def clip_levels(clips: DataFrame) -> DataFrame:
    level = rms(F.col("samples"))
    return clips.select("job_id", "seg_idx", level.alias("rms"), dbfs(level).alias("dbfs"), (F.size("samples") / F.col("sr")).alias("seconds"))


def _clip_frames() -> tuple[list[str], Window]:
    return ["job_id", "seg_idx"], Window.partitionBy("job_id", "seg_idx").orderBy("frame_idx")


def onsets(fr: DataFrame) -> DataFrame:
    """Level above 0.01 and 1.41 times that of the frame before."""
    _, w = _clip_frames()
    return fr.withColumn("onset", F.coalesce((F.col("rms") > 1.41 * F.lag("rms").over(w)) & (F.col("rms") > 0.01), F.lit(False)))


def onset_rate(fr: DataFrame, hop_s: float = 0.01) -> DataFrame:
    return onsets(fr).groupBy("job_id", "seg_idx").agg((F.count_if("onset") / (F.count("*") * hop_s)).alias("onset_rate"))


def noise_floor(fr: DataFrame) -> DataFrame:
    """5th percentile of the levels above zero, in dBFS; ``quiet`` at -55 or less."""
    out = percentiles(fr.filter("rms > 0"), ["job_id", "seg_idx"], "rms", 0.05).select("job_id", "seg_idx", dbfs(F.col("value")).alias("floor_dbfs"))
    return out.withColumn("quiet", F.col("floor_dbfs") <= -55)


def local_median(fr: DataFrame) -> DataFrame:
    _, w = _clip_frames()
    return fr.withColumn("local", F.expr("percentile(rms, 0.5)").over(w.rowsBetween(-40, 0)))


def drops(fr: DataFrame, frame_s: float = 0.05) -> DataFrame:
    """Runs under a tenth of the local median that last 0.6 to 2.0 s and end in normal frames; quiet surroundings cancel a run."""
    _, w = _clip_frames()
    state = F.when(F.col("local") < 0.01, "quiet").when(F.col("rms") < 0.1 * F.col("local"), "low").otherwise("normal")
    labelled = local_median(fr).filter("frame_idx >= 40").withColumn("label", state)
    run = F.sum(F.when(F.coalesce(F.lag("label").over(w), F.lit("")) != F.col("label"), 1).otherwise(0)).over(w)
    runs = labelled.withColumn("run", run).groupBy("job_id", "seg_idx", "run", "label").agg(F.count("*").alias("n"), F.min("frame_idx").alias("start"))
    after = F.lead("label").over(Window.partitionBy("job_id", "seg_idx").orderBy("run"))
    return runs.withColumn("after", after).filter((F.col("label") == "low") & (F.col("after") == "normal") & (F.col("n") * frame_s).between(0.6, 2.0)).select("job_id", "seg_idx", "start", (F.col("n") * frame_s).alias("seconds"))


def trim_bounds(fr: DataFrame, least_blocks: int = 10) -> DataFrame:
    """First and last 10 ms block above -50 dBFS; silence of up to 100 ms is left."""
    loud = F.when(dbfs(F.col("rms")) > -50, F.col("frame_idx"))
    out = fr.groupBy("job_id", "seg_idx").agg(F.min(loud).alias("lo"), F.max(loud).alias("hi"), F.count("*").alias("n"))
    return out.select("job_id", "seg_idx", F.when(F.col("lo") > least_blocks, F.col("lo")).otherwise(0).alias("first_block"), F.when(F.col("n") - 1 - F.col("hi") > least_blocks, F.col("hi") + 1).otherwise(F.col("n")).cast("int").alias("end_block"))


def silence_gaps(fr: DataFrame, frame_s: float = 0.05, least_s: float = 2.0) -> DataFrame:
    """Silences of ``least_s`` or more below -40 dB, per clip."""
    _, w = _clip_frames()
    silent = fr.withColumn("silent", F.coalesce(dbfs(F.col("rms")) < -40, F.lit(True)))
    runs = silent.withColumn("run", F.sum((~F.col("silent")).cast("int")).over(w)).groupBy("job_id", "seg_idx", "run").agg(F.count_if("silent").alias("n"))
    return runs.groupBy("job_id", "seg_idx").agg(F.count_if(F.col("n") * frame_s >= least_s).alias("gaps"))


def job_median_dbfs(levels: DataFrame) -> DataFrame:
    """Median level per job over readable clips, with two or more of them."""
    return percentiles(levels, ["job_id"], "dbfs", 0.5).filter("n >= 2").select("job_id", F.col("value").alias("median_dbfs"))


def loudness_outliers(levels: DataFrame, most: float = 3.0) -> DataFrame:
    return levels.join(job_median_dbfs(levels).hint("merge"), "job_id").filter(F.abs(F.col("dbfs") - F.col("median_dbfs")) > most)


def timeline(segs: DataFrame) -> DataFrame:
    """Start of each segment in the joined audio: what lies before it, less overlaps, plus gaps."""
    w = Window.partitionBy("job_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return segs.withColumn("start_ms", F.coalesce(F.sum(F.col("duration_ms") - F.col("overlap_ms") + F.col("gap_ms")).over(w), F.lit(0)))


def tail(clips: DataFrame, ms: int = 2500) -> DataFrame:
    n = F.least(F.size("samples"), F.floor(F.col("sr") * ms / 1000).cast("int"))
    return clips.withColumn("samples", F.when(n > 0, F.slice("samples", F.size("samples") - n + 1, n)).otherwise(F.slice("samples", 1, 0)))


def trim(clips: DataFrame, quiet_ms: int = 200, least_blocks: int = 10) -> DataFrame:
    """Silence cut at both ends as ``trim_bounds`` says; then the last 200 ms become silence if the clip is longer.  One pass over rows."""
    block, n = F.greatest(F.floor(F.col("sr") / 100).cast("int"), F.lit(1)), F.floor(F.col("sr") * quiet_ms / 1000).cast("int")
    blocks = F.floor(F.size("samples") / block).cast("int")
    every = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    loud = F.filter(every, lambda i: F.coalesce(dbfs(rms(F.slice("samples", i * block + 1, block))) > -50, F.lit(False)))
    names = fresh(clips.columns, "#loud", "#first", "#end")
    bounded = clips.withColumn(names[0], loud).withColumn(names[1], F.coalesce(F.try_element_at(names[0], F.lit(1)), F.lit(0))).withColumn(names[2], F.coalesce(F.try_element_at(names[0], F.lit(-1)), blocks - 1))
    first = F.when(F.col(names[1]) > least_blocks, F.col(names[1])).otherwise(0)
    end = F.when(blocks - 1 - F.col(names[2]) > least_blocks, F.col(names[2]) + 1).otherwise(blocks)
    cut = bounded.withColumn("samples", F.when(blocks == 0, F.col("samples")).otherwise(F.slice("samples", first * block + 1, F.greatest((end - first) * block, F.lit(0)))))
    quiet = F.concat(F.slice("samples", 1, F.greatest(F.size("samples") - n, F.lit(0))), F.array_repeat(F.lit(0.0).cast("float"), n))
    return cut.withColumn("samples", F.when(F.size("samples") > n, quiet).otherwise(F.col("samples"))).select(*clips.columns)


def trimmed(x: np.ndarray, sr: int, quiet_ms: int = 200, least_blocks: int = 10) -> np.ndarray:
    """``trim`` for samples in memory."""
    block, n = max(sr // 100, 1), sr * quiet_ms // 1000
    r = levels(x, block, block)
    if r.size:
        loud = np.flatnonzero(r > 10 ** (-50 / 20))
        lo, hi = (loud[0], loud[-1]) if loud.size else (0, r.size - 1)
        x = x[(lo if lo > least_blocks else 0) * block : (hi + 1 if r.size - 1 - hi > least_blocks else r.size) * block]
    return np.concatenate([x[: x.size - n], np.zeros(n)]) if x.size > n else x


# signal features in numpy


def _strided(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if x.size >= size else np.zeros((0, size))


def pitch(x: np.ndarray, sr: int) -> np.ndarray:
    """Pitch of each 30 ms frame (hop 15 ms) by autocorrelation from 60 to 500 Hz; NaN where unvoiced."""
    size, hop = int(0.03 * sr), int(0.015 * sr)
    fr = _strided(np.asarray(x, np.float64), size, hop)
    lo, hi = int(sr / 500), min(int(sr / 60), size - 1)
    if not len(fr) or hi <= lo:
        return np.zeros(0)
    fr = fr - fr.mean(axis=1, keepdims=True)
    spectrum = np.fft.rfft(fr, 2 * size, axis=1)
    r = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
    lag = lo + r[:, lo : hi + 1].argmax(axis=1)
    peak, half = r[np.arange(len(r)), lag], lag // 2
    octave = (half >= lo) & (r[np.arange(len(r)), half] >= 0.9 * peak)
    lag = np.where(octave, half, lag)
    return np.where((r[:, 0] > 1e-8) & (peak > 0.5 * r[:, 0]), sr / lag, np.nan)


def flatness_of_frames(x: np.ndarray) -> np.ndarray:
    """Spectral flatness of each 512-sample Hann frame (hop 128); NaN where the mean magnitude doesn't pass 0.005."""
    fr = _strided(np.asarray(x, np.float64), 512, 128)
    m = np.abs(np.fft.rfft(fr * np.hanning(512), axis=1)) + 1e-10
    level = m.mean(axis=1)
    return np.where(level > 0.005, np.exp(np.log(m).mean(axis=1)) / level, np.nan)


def flatness(x: np.ndarray) -> float:
    """Mean over the voiced frames, 0 without one."""
    f = flatness_of_frames(x)
    f = f[~np.isnan(f)]
    return float(f.mean()) if f.size else 0.0


def median_f0(x: np.ndarray, sr: int) -> float | None:
    f = pitch(x, sr)
    f = f[~np.isnan(f)]
    return float(np.median(f)) if f.size >= 10 else None


def bad_windows(x: np.ndarray, sr: int, reference: float) -> tuple[int, int]:
    """3 s windows, half overlapping, whose median pitch is over 6 semitones off; and windows judged."""
    size, bad, judged = 3 * sr, 0, 0
    for start in range(0, max(len(x) - size, 0) + 1, size // 2):
        part = np.asarray(x[start : start + size], np.float64)
        f = pitch(part, sr)
        f = f[~np.isnan(f)]
        if np.sqrt((part**2).mean() if part.size else 0) < 0.02 or f.size < 3:
            continue
        judged += 1
        bad += abs(12 * np.log2(np.median(f) / reference)) > 6
    return bad, judged


def levels(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """RMS of each frame."""
    total = np.concatenate([[0.0], np.cumsum(np.asarray(x, np.float64) ** 2)])
    start = np.arange(0, max(len(x) - size + 1, 0), hop)
    return np.sqrt(np.maximum(total[start + size] - total[start], 0) / size)


def onsets_per_second(x: np.ndarray, sr: int) -> float:
    """Frames of 25 ms (hop 10 ms) over 0.01 and 1.41 times the one before, for each second of frames."""
    r = levels(x, int(0.025 * sr), max(int(0.01 * sr), 1))
    return float(((r[1:] > 1.41 * r[:-1]) & (r[1:] > 0.01)).sum() / (r.size * 0.01)) if r.size else 0.0


def count_drops(x: np.ndarray, sr: int) -> int:
    """Drops as ``drops`` finds them, in one clip's 50 ms frames."""
    size = int(0.05 * sr)
    r = levels(x[:-1], size, max(size, 1))  # the last full frame is left out if nothing follows it
    if r.size <= 40:
        return 0
    local = np.median(_strided(r, 41, 1), axis=1)
    r = r[40:]
    label = np.where(local < 0.01, 0, np.where(r < 0.1 * local, 1, 2))
    edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
    n, kind = np.diff(edge), label[edge[:-1]]
    after = np.append(kind[1:], -1)
    return int(((kind == 1) & (after == 2) & (n * 0.05 >= 0.6) & (n * 0.05 <= 2.0)).sum())


FEATURES = "job_id string, seg_idx int, f0 double, flatness double, bad_windows int, windows int, lufs double, true_peak_dbfs double"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            x, ref = np.asarray(r.samples, np.float64), getattr(r, "ref_f0", None)
            f0 = median_f0(x, r.sr)
            bad, n = bad_windows(x, r.sr, ref) if ref and not np.isnan(ref) else (0, 0)
            rows.append((r.job_id, r.seg_idx, f0, flatness(x), bad, n, integrated_lufs(x, r.sr), true_peak(x)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


_GATE = "job_id string, seg_idx int, seconds double, early string, ref_f0 double, f0 double, flatness double, bad_windows int, windows int, onset_rate double, drops int"


def _gate_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the gate asks of each clip, in one pass; nothing is worked out for clips that have failed before."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            if r.samples is None or isinstance(r.early, str):
                rows.append((None, None, 0, 0, 0.0, 0))
                continue
            x, sr = np.asarray(r.samples, np.float64), int(r.sr)
            ref = r.ref_f0 if r.ref_f0 is not None and not np.isnan(r.ref_f0) else None
            rows.append((median_f0(x, sr), flatness(x), *(bad_windows(x, sr, ref) if ref else (0, 0)), onsets_per_second(x, sr), count_drops(x, sr)))
        names = [c.split()[0] for c in _GATE.split(", ")]
        found = pd.DataFrame(rows, columns=names[5:], index=pdf.index)
        yield pd.concat([pdf[names[:5]], found], axis=1)


def features(clips: DataFrame) -> DataFrame:
    """Pitch, flatness, pitch windows, loudness and true peak of each clip; ``ref_f0`` is used if there."""
    return clips.mapInPandas(_features, FEATURES)


def frame_f0(clips: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                f = pitch(r.samples, r.sr)
                yield pd.DataFrame({"job_id": r.job_id, "seg_idx": r.seg_idx, "frame_idx": np.arange(f.size, dtype=np.int32), "f0": f})

    return clips.mapInPandas(run, "job_id string, seg_idx int, frame_idx int, f0 double").withColumn("f0", F.when(~F.isnan("f0"), F.col("f0")))


def frame_flatness(clips: DataFrame) -> DataFrame:
    """A row for each spectral frame; null where it isn't voiced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                f = flatness_of_frames(r.samples)
                yield pd.DataFrame({"job_id": r.job_id, "seg_idx": r.seg_idx, "frame_idx": np.arange(f.size, dtype=np.int32), "flatness": f})

    return clips.mapInPandas(run, "job_id string, seg_idx int, frame_idx int, flatness double").withColumn("flatness", F.when(~F.isnan("flatness"), F.col("flatness")))


def mean_flatness(fr: DataFrame) -> DataFrame:
    return fr.groupBy("job_id", "seg_idx").agg(F.coalesce(F.avg("flatness"), F.lit(0.0)).alias("flatness"))


def windowed_f0(fr: DataFrame, reference: float, hop_s: float = 0.015, window_s: float = 3.0, most: float = 6.0) -> DataFrame:
    """``fr(job_id, seg_idx, frame_idx, f0, rms)`` -> per window of 3 s, half overlapping, its median pitch and whether it is over 6 semitones off.

    Windows of a level under 0.02 or with fewer than 3 voiced frames are skipped.
    """
    half = int(window_s / hop_s / 2)
    last = F.floor(F.col("frame_idx") / half).cast("int")
    placed = fr.withColumn("window", F.explode(F.filter(F.array(last - 1, last), lambda x: x >= 0)))
    out = placed.groupBy("job_id", "seg_idx", "window").agg(F.median("f0").alias("f0"), F.count("f0").alias("voiced"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("level"))
    return out.filter("level >= 0.02 and voiced >= 3").select("job_id", "seg_idx", "window", "f0", (semitones(F.col("f0"), F.lit(reference)) > most).alias("bad"))


def median_f0_of_frames(fr: DataFrame) -> DataFrame:
    found = percentiles(fr, ["job_id", "seg_idx"], "f0", 0.5).select("job_id", "seg_idx", F.when(F.col("n") >= 10, F.col("value")).alias("f0"))
    return fr.select("job_id", "seg_idx").distinct().join(found.hint("merge"), ["job_id", "seg_idx"], "left")


# loudness after the public ITU-R BS.1770 and EBU R128 documents


def _k_weighted(x: np.ndarray, sr: int) -> np.ndarray:
    """Both K filters, applied in the frequency domain."""

    def response(b: list[float], a: list[float], z: np.ndarray) -> np.ndarray:
        return (b[0] + b[1] / z + b[2] / z**2) / (a[0] + a[1] / z + a[2] / z**2)

    n = 1 << int(np.ceil(np.log2(max(x.size + sr, 2))))
    z = np.exp(2j * np.pi * np.fft.rfftfreq(n))
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, vh = np.tan(np.pi * f0 / sr), 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    shelf = response([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k], [1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k], z)
    f0, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f0 / sr)
    high = response([1, -2, 1], [1 + k / q + k * k, 2 * (k * k - 1), 1 - k / q + k * k], z) * (1 + k / q + k * k)
    return np.fft.irfft(np.fft.rfft(x, n) * shelf * high / (1 + k / q + k * k), n)[: x.size]


def integrated_lufs(x: np.ndarray, sr: int) -> float | None:
    """400 ms blocks with 75 % overlap, gated at -70 LUFS and 10 LU below the mean of what passes."""
    hop = max(int(0.1 * sr), 1)
    blocks = _strided(_k_weighted(np.asarray(x, np.float64), sr), 4 * hop, hop)
    if not len(blocks):
        return None
    power = (blocks**2).mean(axis=1)
    loud = power[power > 10 ** ((-70 + 0.691) / 10)]
    if not loud.size:
        return None
    return float(-0.691 + 10 * np.log10(loud[loud > loud.mean() / 10].mean()))


def oversampled(x: np.ndarray) -> np.ndarray:
    """``x`` at four times its rate."""
    spectrum = np.zeros(2 * x.size + 1, dtype=complex)
    spectrum[: x.size // 2 + 1] = np.fft.rfft(x)
    return np.fft.irfft(spectrum, 4 * x.size) * 4


def true_peak(x: np.ndarray) -> float | None:
    """dB of the peak after four-fold oversampling."""
    x = np.asarray(x, np.float64)
    peak = np.abs(oversampled(x)).max() if x.size else 0
    return float(20 * np.log10(peak)) if peak > 0 else None


def gain_plan(metrics: DataFrame, target: float = -16.0) -> DataFrame:
    """Linear gain to the target, limited by a peak ceiling of -2.0 dB (-2.5 where the peak is above -1.0); clips under 10 s keep theirs."""
    ceiling = F.when(F.col("true_peak_dbfs") > -1.0, -2.5).otherwise(-2.0)
    db = F.least(F.lit(target) - F.col("lufs"), ceiling - F.col("true_peak_dbfs"))
    return metrics.withColumn("gain", F.when(F.col("lufs").isNull() | (F.col("seconds") < 10), 1.0).otherwise(F.pow(F.lit(10.0), db / 20)))


def apply_gain(clips: DataFrame, plan: DataFrame) -> DataFrame:
    return clips.join(plan.select("job_id", "seg_idx", "gain").hint("merge"), ["job_id", "seg_idx"]).withColumn("samples", F.transform("samples", lambda x: (x * F.col("gain")).cast("float"))).drop("gain")


# the gate


def acoustic_gate(clips: DataFrame, dry_run: bool = False) -> DataFrame:
    """``clips`` with word_count and ref_f0 -> (job_id, seg_idx, passed, reason): the first reason in order wins.

    Cheap columns come first; samples of clips that fail them aren't sent on, and one pass over the
    others yields pitch, spectra, onsets and drops together, so there is neither join nor shuffle.
    """
    seconds = F.size("samples") / F.col("sr")
    want = expected_seconds(F.col("word_count"))
    early = F.when(F.col("samples").isNull(), "unreadable").when(seconds < 0.1, "empty").when(seconds > want * 1.6, "too long").when(seconds < want * 0.4, "too short")
    staged = clips.select("job_id", "seg_idx", "sr", "ref_f0", seconds.alias("seconds"), early.alias("early"), F.when(early.isNull(), F.col("samples")).alias("samples"))
    judged = staged.mapInPandas(_gate_features, _GATE)
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(semitones(F.col("f0"), F.col("ref_f0")) > 2.5, "speaker drift")
        .when((F.col("onset_rate") > 8) & (F.col("flatness") > 0.18), "noise bursts")
        .when(F.col("bad_windows") > F.greatest(F.lit(2.0), 0.05 * F.col("windows")), "windowed gate")
        .when(F.col("drops") > F.greatest(F.lit(3), F.floor(F.col("seconds") / 20)), "mid-phrase drops")
    )
    out = judged.select("job_id", "seg_idx", reason.alias("reason"))
    return out.withColumn("passed", F.lit(True) if dry_run else F.col("reason").isNull())


# joining


def crossfade(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Equal-power fade over ``n`` samples in 16-bit steps; plain append if either side is shorter."""
    if n <= 0 or a.size < n or b.size < n:
        return np.concatenate([a, b])
    t = np.linspace(0, np.pi / 2, n)
    mid = np.clip(np.round((a[-n:] * np.cos(t) + b[:n] * np.sin(t)) * 32768), -32768, 32767) / 32768
    return np.concatenate([a[:-n], mid, b[n:]])


class Joiner:
    """One job's audio as it grows: what no later clip can change is handed on, and only the end that the next fade needs stays."""

    def __init__(self, fade: int):
        self.fade, self.total, self.tail = fade, 0, np.zeros(0)

    def add(self, x: np.ndarray, quiet: int = 0) -> np.ndarray:
        """``x`` after ``quiet`` samples of silence, or faded in if both sides are as long as the fade; returns what is settled."""
        if self.fade and self.total >= self.fade and x.size >= self.fade:
            x, self.total, self.tail = crossfade(self.tail, x, self.fade), self.total - self.fade, np.zeros(0)
        whole = np.concatenate([self.tail, np.zeros(quiet), x])
        self.total += whole.size - self.tail.size
        at = max(whole.size - self.fade, 0)
        self.tail = whole[at:].copy()
        return whole[:at]


JOINED = "job_id string, part_idx int, sr int, samples array<float>"
#: How many samples are joined before they leave the worker.
_HANDED_ON = 1 << 20


def _joined(clips: Iterator[tuple], mode: str, overlap_ms: int) -> Iterator[tuple]:
    """(job_id, sr, samples, gap_ms) in order -> (job_id, part_idx, sr, samples)."""
    now, joiner, sr, part, gap, begun = None, None, 0, 0, 0, False

    def ended() -> Iterator[tuple]:
        if begun and (joiner.tail.size or not part):
            yield now, part, sr, joiner.tail.astype(np.float32)

    for job, rate, samples, gap_after in clips:
        if not begun or job != now:
            yield from ended()
            now, sr, part, gap, begun = job, int(rate), 0, 0, True
            joiner = Joiner(int(overlap_ms * sr / 1000) if mode == "overlap" else 0)
        settled = joiner.add(np.asarray(samples if samples is not None else [], np.float64), int(gap * sr / 1000) if mode != "overlap" else 0)
        gap = 0 if gap_after is None or gap_after != gap_after else gap_after
        if settled.size:
            yield now, part, sr, settled.astype(np.float32)
            part += 1
    yield from ended()


def join_clips(clips: DataFrame, mode: str = "gap", overlap_ms: int = 500) -> DataFrame:
    """A job's clips in order, with ``gap_ms`` of silence after each or a crossfade -> (job_id, part_idx, sr, samples).

    Clips go through a task one by one in order; a part is what a clip has settled, so memory holds one clip and the fade's tail,
    however long the job.  Spark hands clips over in batches: bound these by ``spark.sql.execution.arrow.maxRecordsPerBatch`` where clips are long.
    """
    gap = F.col("gap_ms") if "gap_ms" in clips.columns else F.lit(0)
    rows = clips.select("job_id", "sr", "samples", gap.cast("double").alias("gap_ms"), "seg_idx").repartition("job_id").sortWithinPartitions("job_id", "seg_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r[:4] for pdf in batches for r in pdf.itertuples(index=False, name=None))
        out, held = [], 0
        for part in _joined(rows, mode, overlap_ms):
            out.append(part)
            held += part[3].size
            if held >= _HANDED_ON:
                yield pd.DataFrame(out, columns=["job_id", "part_idx", "sr", "samples"])
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["job_id", "part_idx", "sr", "samples"])

    return rows.mapInPandas(run, JOINED)


def whole_jobs(parts: DataFrame) -> DataFrame:
    """Parts of ``join_clips`` put together: (job_id, sr, samples), for jobs that fit into a row."""
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "samples")))
    return parts.groupBy("job_id").agg(F.first("sr").alias("sr"), ordered.alias("o")).select("job_id", "sr", F.flatten(F.transform("o", lambda x: x["samples"])).alias("samples"))


# loudness, peak and gaps of joined audio

_MEASURES = "job_id string, kind string, idx int, value double"
#: Seconds of audio before a part that its filter is given, by when it has forgotten what came earlier; samples around a part for its peaks.
_CONTEXT_S, _AROUND = 1.0, 256


def _measured(parts: Iterator[tuple]) -> Iterator[tuple]:
    """(job_id, sr, samples) in order -> (job_id, kind, idx, value): powers of 400 ms blocks (hop 100 ms), levels of 50 ms frames, and peaks, across the borders of parts."""
    now, sr, begun = None, 0, False

    def start():
        return {"before": np.zeros(0), "k": np.zeros(0), "steps": [], "block": 0, "frame": 0, "raw": np.zeros(0), "end": np.zeros(2 * _AROUND)}

    def peaks(s: dict, x: np.ndarray) -> Iterator[tuple]:
        """The peak between the samples around ``x``, which are faded so that their ends don't ring."""
        whole = np.concatenate([s["end"], x])
        s["end"] = whole[-2 * _AROUND :].copy()
        ramp = np.sin(np.linspace(0, np.pi / 2, _AROUND // 2)) ** 2
        whole[: ramp.size] *= ramp
        whole[-ramp.size :] *= ramp[::-1]
        peak = np.abs(oversampled(whole)[4 * _AROUND : -4 * _AROUND]).max()
        if peak > 0:
            yield "peak", 0, float(20 * np.log10(peak))

    def work(s: dict, x: np.ndarray) -> Iterator[tuple]:
        hop, size = max(int(0.1 * sr), 1), int(0.05 * sr)
        context = s["before"].size
        s["k"] = np.concatenate([s["k"], _k_weighted(np.concatenate([s["before"], x]), sr)[context:]])
        s["before"] = np.concatenate([s["before"], x])[-int(_CONTEXT_S * sr) :]
        n = s["k"].size // hop
        s["steps"] += (s["k"][: n * hop].reshape(n, hop) ** 2).sum(axis=1).tolist()
        s["k"] = s["k"][n * hop :]
        while len(s["steps"]) >= 4:
            yield "block", s["block"], sum(s["steps"][:4]) / (4 * hop)
            s["steps"].pop(0)
            s["block"] += 1
        s["raw"] = np.concatenate([s["raw"], x])
        n = s["raw"].size // size if size else 0
        for level in np.sqrt((s["raw"][: n * size].reshape(n, size) ** 2).mean(axis=1)).tolist() if n else []:
            yield "frame", s["frame"], level
            s["frame"] += 1
        s["raw"] = s["raw"][n * size :]
        yield from peaks(s, x)

    state = start()
    for job, rate, samples in parts:
        if not begun or job != now:
            if begun:
                yield from ((now, *m) for m in peaks(state, np.zeros(2 * _AROUND)))
            now, sr, state, begun = job, int(rate), start(), True
        for a in range(0, len(samples), 30 * sr):  # a long part in pieces
            yield from ((now, *m) for m in work(state, np.asarray(samples[a : a + 30 * sr], np.float64)))
    if begun:
        yield from ((now, *m) for m in peaks(state, np.zeros(2 * _AROUND)))


def measures(parts: DataFrame) -> DataFrame:
    """Parts of ``join_clips`` -> rows (job_id, kind, idx, value) of kind block, frame or peak."""
    rows = parts.select("job_id", "sr", "samples", "part_idx").repartition("job_id").sortWithinPartitions("job_id", "part_idx")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for m in _measured(r[:3] for pdf in batches for r in pdf.itertuples(index=False, name=None)):
            held.append(m)
            if len(held) == 5000:
                yield pd.DataFrame(held, columns=["job_id", "kind", "idx", "value"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["job_id", "kind", "idx", "value"])

    return rows.mapInPandas(run, _MEASURES)


def gated_loudness(blocks: DataFrame) -> DataFrame:
    """``blocks(job_id, power)`` -> (job_id, integrated_lufs): the mean power of blocks above -70 LUFS and above 10 LU below these blocks' mean; null without any."""
    loud = F.col("power") > 10 ** ((-70 + 0.691) / 10)
    first = blocks.groupBy("job_id").agg(F.avg(F.when(loud, F.col("power"))).alias("mean"))
    both = blocks.filter(loud).join(first.hint("merge"), "job_id").filter(F.col("power") > F.col("mean") / 10).groupBy("job_id").agg(F.avg("power").alias("kept"))
    return first.join(both.hint("merge"), "job_id", "left").select("job_id", (F.lit(-0.691) + 10 * F.log10("kept")).alias("integrated_lufs"))


def final_metrics(parts: DataFrame) -> DataFrame:
    """Joined audio -> (job_id, integrated_lufs, true_peak_dbfs, long_silence_gaps) of each whole job, as ``checks.final_gate`` asks.

    Signals are worked once: their measures, numbers only, are kept for the four aggregates over them.
    """
    found = checkpointed(measures(parts))
    loud = gated_loudness(found.filter("kind = 'block'").select("job_id", F.col("value").alias("power")))
    peaks = found.groupBy("job_id").agg(F.max(F.when(F.col("kind") == "peak", F.col("value"))).alias("true_peak_dbfs"))
    frames = found.filter("kind = 'frame'").select("job_id", F.lit(0).alias("seg_idx"), F.col("idx").alias("frame_idx"), F.col("value").alias("rms"))
    gaps = silence_gaps(frames).select("job_id", F.col("gaps").cast("int").alias("long_silence_gaps"))
    return peaks.join(loud.hint("merge"), "job_id", "left").join(gaps.hint("merge"), "job_id", "left")


def join_with_gap(parts: DataFrame, ms: int) -> DataFrame:
    """Sub-parts in order with fixed silence between, natively."""
    ordered = F.array_sort(F.collect_list(F.struct("part_idx", "samples")))
    out = parts.groupBy("job_id", "seg_idx", "sr").agg(ordered.alias("o"))
    quiet = F.array_repeat(F.lit(0.0).cast("float"), F.floor(F.col("sr") * ms / 1000).cast("int"))
    spaced = F.flatten(F.transform("o", lambda x, i: F.when(i == 0, x["samples"]).otherwise(F.concat(quiet, x["samples"]))))
    return out.select("job_id", "seg_idx", "sr", spaced.alias("samples"))


#: Of the filter that changes rates: its cutoff as a share of the lower half rate, and zero crossings of its sinc on each side.
_CUTOFF, _CROSSINGS = 0.95, 64


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """Weights of the input around each of ``up`` places between two of its samples: a sinc under a Blackman window, their sum 1."""
    cutoff = _CUTOFF * min(1.0, up / down)
    half = int(np.ceil(_CROSSINGS / cutoff))
    t = np.arange(1 - half, half + 1) - np.arange(up)[:, None] / up
    window = np.where(np.abs(t) < half, 0.42 + 0.5 * np.cos(np.pi * t / half) + 0.08 * np.cos(2 * np.pi * t / half), 0)
    w = np.sinc(cutoff * t) * window
    return w / w.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """``x`` at another rate by a band-limited polyphase filter; its ends are held."""
    if old == new or not x.size:
        return x
    up, down = new // gcd(old, new), old // gcd(old, new)
    weights = _phases(up, down)
    n, half = round(x.size * new / old), weights.shape[1] // 2
    padded = np.concatenate([np.full(half - 1, x[0]), x, np.full(half + 1, x[-1])])
    view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n)
    for a in range(0, n, 4096):
        place = np.arange(a, min(a + 4096, n)) * down
        out[a : a + 4096] = np.einsum("ij,ij->i", view[np.minimum(place // up, len(view) - 1)], weights[place % up])
    return out


def convert(clips: DataFrame, sr: int, channels: int = 1) -> DataFrame:
    """To another sample rate, without what the new rate can't hold, and number of channels; values held in 16 bits.

    ``clips`` may have a column ``channels`` (1 without it); samples of several channels are interleaved.
    From many to one channel is their mean, from one to many a copy each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = np.asarray(r.samples, np.float64).reshape(-1, int(r.channels))
                if x.shape[1] != channels:
                    x = np.repeat(x.mean(axis=1, keepdims=True), channels, axis=1)
                y = np.stack([resampled(c, int(r.sr), sr) for c in x.T], axis=1).reshape(-1)
                out.append((np.clip(np.round(y * 32768), -32768, 32767) / 32768).astype(np.float32))
            yield pdf[["job_id", "seg_idx"]].assign(sr=np.int32(sr), channels=np.int32(channels), samples=out)

    given = F.col("channels") if "channels" in clips.columns else F.lit(1)
    return clips.select("job_id", "seg_idx", "sr", given.cast("int").alias("channels"), "samples").mapInPandas(run, "job_id string, seg_idx int, sr int, channels int, samples array<float>")


def long_enough(clips: DataFrame, seconds: float = 10.0) -> DataFrame:
    return clips.filter(F.size("samples") / F.col("sr") >= seconds)


def voice_report(voices: DataFrame) -> DataFrame:
    """``voices(name, sr, samples)`` -> name, seconds, floor_dbfs, errors."""
    clips = voices.select(F.col("name").alias("job_id"), F.lit(0).alias("seg_idx"), "sr", "samples")
    floor = noise_floor(frame_rms(frames(clips, 50, 50)))
    out = clips.select("job_id", (F.size("samples") / F.col("sr")).alias("seconds")).join(floor.select("job_id", "floor_dbfs").hint("merge"), "job_id", "left")
    errors = F.array_compact(F.array(F.when(F.col("seconds") < 5, "too short"), F.when(F.col("seconds") > 120, "too long"), F.when(F.col("floor_dbfs") > -55, "noisy")))
    return out.select(F.col("job_id").alias("name"), "seconds", "floor_dbfs", errors.alias("errors"))


def with_reference_f0(clips: DataFrame, voices: DataFrame) -> DataFrame:
    """Per-voice reference pitch; voices may be many, and their pitches come from Python."""
    return clips.join(voices.select("voice", F.col("f0").alias("ref_f0")).hint("merge"), "voice", "left")


def pair_transcripts(clips: DataFrame, transcripts: DataFrame, most_ms: int = 120_000) -> DataFrame:
    return clips.filter(F.col("duration_ms") <= most_ms).join(transcripts.filter(F.trim("transcript") != "").hint("merge"), ["job_id", "seg_idx"], "left")
