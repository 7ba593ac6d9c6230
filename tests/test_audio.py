"""Generated signals through the detectors, the gate and the joiners."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechprep.operators import audio

SR = 8000


def sine(f, s, amp=0.5, sr=SR):
    return amp * np.sin(2 * np.pi * f * np.arange(int(s * sr)) / sr)


def speech(f, s, sr=SR):
    t = np.arange(int(s * sr)) / sr
    return 0.3 * (np.sin(2 * np.pi * f * t) + 0.5 * np.sin(4 * np.pi * f * t) + 0.25 * np.sin(6 * np.pi * f * t)) * (0.6 + 0.4 * np.sin(2 * np.pi * 1.5 * t) ** 2)


def with_drops(n, each, total):
    x = sine(150, total)
    for k in range(n):
        a = int((3 + k * (total - 4) / max(n, 1)) * SR)
        x[a : a + int(each * SR)] *= 0.01
    return x


def clips(spark, rows):
    return spark.createDataFrame([(str(k), 0, SR, [float(v) for v in x], w, ref) for k, (x, w, ref) in enumerate(rows)], "job_id string, seg_idx int, sr int, samples array<float>, word_count int, ref_f0 double")


def test_features():
    assert audio.median_f0(np.zeros(SR), SR) is None
    assert audio.median_f0(sine(200, 2), SR) == pytest.approx(200, rel=0.03)
    assert 96 < audio.median_f0(sine(120, 3) + 0.8 * sine(240, 3) + 0.4 * sine(360, 3), SR) < 145
    assert audio.median_f0(sine(200, 0.1), SR) is None
    assert audio.flatness(np.zeros(SR)) == 0.0
    assert audio.flatness(sine(200, 2)) < 0.1 < audio.flatness(0.3 * np.random.default_rng(0).standard_normal(SR))


def test_loudness():
    sr = 48000
    assert audio.integrated_lufs(sine(997, 5, 10 ** (-20 / 20), sr), sr) == pytest.approx(-23.01, abs=0.15)
    assert audio.true_peak(sine(100, 1, 0.5)) == pytest.approx(-6.02, abs=0.1)
    assert audio.integrated_lufs(np.zeros(sr), sr) is None


def test_gate(spark):
    noise = np.random.default_rng(1).standard_normal
    bursts = np.zeros(10 * SR)
    for k in range(100):
        bursts[k * SR // 10 : k * SR // 10 + SR // 20] = 0.3 * noise(SR // 20)
    cases = [
        (sine(150, 60), 5, None, "too long"),
        (speech(120, 20), 50, None, None),
        (np.zeros(SR // 20), 10, None, "empty"),
        (bursts, 25, None, "noise bursts"),
        (sine(400, 5), 12, 100.0, "speaker drift"),
        (np.concatenate([speech(120, 20), speech(480, 10)]), 75, 120.0, "windowed gate"),
        (speech(120, 20), 50, 115.0, None),
        (np.concatenate([speech(120, 10), speech(480, 10)]), 50, None, None),
        (with_drops(4, 0.8, 20), 50, None, "mid-phrase drops"),
        (with_drops(2, 0.8, 20), 50, None, None),
        (with_drops(6, 0.4, 20), 50, None, None),
    ]
    df = clips(spark, [c[:3] for c in cases])
    got = {int(r.job_id): r.reason for r in audio.acoustic_gate(df).collect()}
    assert got == {k: c[3] for k, c in enumerate(cases)}
    assert all(r.passed for r in audio.acoustic_gate(df.limit(1), dry_run=True).collect())


def test_gate_counts_what_the_frame_tables_say(spark):
    rows = [(with_drops(n, each, 20), 50, None) for n, each in ((4, 0.8), (2, 0.7), (6, 0.4), (3, 2.5))] + [(speech(120, 3), 7, None), (np.zeros(SR), 1, None)]
    df = clips(spark, rows)
    fr = audio.frame_rms(audio.frames(df, 50, 50, inclusive=False))
    found = {int(r.job_id): r["count"] for r in audio.drops(fr).groupBy("job_id").count().collect()}
    rate = {int(r.job_id): r.onset_rate for r in audio.onset_rate(audio.frame_rms(audio.frames(df, 25, 10))).collect()}
    for k, (x, _, _) in enumerate(rows):
        x = x.astype(np.float32)
        assert audio.count_drops(x, SR) == found.get(k, 0) and audio.onsets_per_second(x, SR) == pytest.approx(rate[k])
    flat = {int(r.job_id): r.flatness for r in audio.mean_flatness(audio.frame_flatness(df)).collect()}
    assert flat == pytest.approx({k: audio.flatness(x.astype(np.float32)) for k, (x, _, _) in enumerate(rows)})


def test_trim_in_memory_equals_trim(spark):
    parts = [np.zeros(SR // 2), sine(200, 0.7), np.zeros(SR)]
    rows = [(np.concatenate(x), 1, None) for x in (parts, parts[1:], parts[:2], parts[:1])] + [(sine(200, 0.1), 1, None), (np.zeros(3), 1, None)]
    got = {int(r.job_id): r.samples for r in audio.trim(clips(spark, rows).drop("word_count", "ref_f0")).collect()}
    for k, (x, _, _) in enumerate(rows):
        assert got[k] == pytest.approx(list(audio.trimmed(x.astype(np.float32).astype(float), SR)), abs=1e-6)
    assert len(got[0]) == int(0.7 * SR)


def test_channels(spark):
    df = spark.createDataFrame([("j", 0, 10, 2, [0.5, -0.5, 0.25, 0.75])], "job_id string, seg_idx int, sr int, channels int, samples array<float>")
    assert audio.convert(df, 10).first().samples == [0.0, 0.5]
    assert audio.convert(df.drop("channels"), 10, 2).first().samples == [0.5, 0.5, -0.5, -0.5, 0.25, 0.25, 0.75, 0.75]
    assert len(audio.convert(df, 20, 2).first().samples) == 8


def test_joins(spark):
    two = spark.createDataFrame([("j", k, SR, [float(v) for v in sine(200, 1)], 250) for k in range(2)], "job_id string, seg_idx int, sr int, samples array<float>, gap_ms int")
    assert [len(r.samples) for r in audio.join_clips(two).orderBy("part_idx").collect()] == [SR, SR + SR // 4]
    assert len(audio.whole_jobs(audio.join_clips(two, "overlap")).first().samples) == 2 * SR - SR // 2
    a, b = sine(200, 1), sine(200, 1)
    mid = audio.crossfade(a, b, SR // 2)[SR // 2 : SR]
    assert np.sqrt((mid**2).mean()) > 0.25
    assert audio.crossfade(a[:10], b, 100).size == 10 + b.size
    parts = spark.createDataFrame([("j", 0, 10, 1, [1.0]), ("j", 0, 10, 0, [2.0])], "job_id string, seg_idx int, sr int, part_idx int, samples array<float>")
    assert audio.join_with_gap(parts, 200).first().samples == [2.0, 0.0, 0.0, 1.0]
    half = audio.convert(two.drop("gap_ms"), SR // 2).first()
    assert half.sr == SR // 2 and len(half.samples) == SR // 2


def test_trim_and_gain(spark):
    x = np.concatenate([sine(200, 1), np.zeros(SR // 2)])
    df = clips(spark, [(x, 1, None)]).drop("word_count", "ref_f0")
    n = len(audio.trim(df).first().samples)
    assert 0.9 * SR <= n <= 1.1 * SR
    m = spark.createDataFrame([("j", 0, -26.0, -20.0, 30.0), ("j", 1, -26.0, -3.0, 30.0), ("j", 2, -26.0, -20.0, 5.0)], "job_id string, seg_idx int, lufs double, true_peak_dbfs double, seconds double")
    assert [r.gain for r in audio.gain_plan(m).orderBy("seg_idx").collect()] == pytest.approx([10**0.5, 10**0.05, 1.0])


def test_voices(spark):
    ok = np.concatenate([sine(150, 5, 0.25), sine(150, 5, 0.001)])
    v = spark.createDataFrame([("ok", SR, [float(x) for x in ok]), ("short", SR, [float(x) for x in sine(150, 3)])], "name string, sr int, samples array<float>")
    got = {r["name"]: r.errors for r in audio.voice_report(v).collect()}
    assert got["ok"] == [] and "too short" in got["short"]


def test_frames_need_order_not_partitions(spark):
    x = clips(spark, [(sine(200, 1), 1, None)])
    a = audio.onsets(audio.frame_rms(audio.frames(x, 25, 10)))
    b = audio.onsets(audio.frame_rms(audio.frames(x, 25, 10)).repartition(3))
    assert a.filter("onset").count() == b.filter("onset").count()
    assert audio.frames(x, 25, 10, inclusive=False).count() <= audio.frames(x, 25, 10).count()
    assert a.select(F.max("frame_idx")).first()[0] == 97


def at_once(parts, mode, overlap_ms, sr):
    """All clips of a job joined in memory."""
    out, gap = None, 0
    for x, after in parts:
        x = np.asarray(x, np.float64)
        if out is None:
            out = x
        elif mode == "overlap":
            out = audio.crossfade(out, x, int(overlap_ms * sr / 1000))
        else:
            out = np.concatenate([out, np.zeros(int(gap * sr / 1000)), x])
        gap = after or 0
    return out.astype(np.float32)


@pytest.mark.parametrize(("mode", "overlap_ms"), [("gap", 0), ("overlap", 100), ("overlap", 7)])
def test_parts_make_the_whole(spark, mode, overlap_ms):
    rng = np.random.default_rng(4)
    jobs = {j: [(rng.uniform(-1, 1, rng.choice([0, 3, 40, 99, 100, 101, 500])).astype(np.float32), int(rng.choice([0, 20, 250]))) for _ in range(n)] for j, n in (("a", 30), ("b", 1), ("c", 7), ("d", 2))}
    rows = [(j, k, 1000, [float(v) for v in x], gap) for j, clips in jobs.items() for k, (x, gap) in enumerate(clips)]
    df = spark.createDataFrame(rows, "job_id string, seg_idx int, sr int, samples array<float>, gap_ms int").repartition(4)
    parts = audio.join_clips(df, mode, overlap_ms)
    for r in audio.whole_jobs(parts).collect():
        assert np.array_equal(np.array(r.samples, np.float32), at_once(jobs[r.job_id], mode, overlap_ms, 1000))
    for j in jobs:
        idx = sorted(r.part_idx for r in parts.filter(F.col("job_id") == j).collect())
        assert idx == list(range(len(idx))) and idx


@pytest.mark.parametrize("mode", ["gap", "overlap"])
def test_a_long_job_never_holds_more_than_two_clips(mode):
    import gc
    import weakref

    alive, most = [], 0

    class Clip(np.ndarray):
        pass

    def clips():
        nonlocal alive
        for _ in range(500):
            x = sine(200, 1).view(Clip)
            alive.append(weakref.ref(x))
            yield "j", SR, x, 100
            del x

    longest = 0
    for part in audio._joined(clips(), mode, 500):
        gc.collect(0)
        alive = [r for r in alive if r() is not None]
        most, longest = max(most, len(alive)), max(longest, part[3].size)
    assert 0 < most <= 2 and longest <= 2 * SR


def test_loudness_of_a_job_is_that_of_the_uncut_clip(spark):
    sr = 8000
    x = np.concatenate([speech(130, 7.3, sr), 0.001 * sine(90, 3, 1.0, sr), speech(180, 4.1, sr), np.zeros(2 * sr + sr // 3), speech(110, 2, sr)]).astype(np.float32)
    for cuts in ([], [sr, sr + 77, 5 * sr, 9 * sr + 1], list(range(333, x.size, 3001))):
        edges = [0, *cuts, x.size]
        rows = [("j", k, sr, [float(v) for v in x[a:b]]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        parts = spark.createDataFrame(rows, "job_id string, part_idx int, sr int, samples array<float>").repartition(3)
        got = audio.final_metrics(parts).first()
        assert got.integrated_lufs == pytest.approx(audio.integrated_lufs(x, sr), abs=1e-4)
        assert got.true_peak_dbfs == pytest.approx(audio.true_peak(x), abs=0.05)
        assert got.long_silence_gaps == 2
    quiet = spark.createDataFrame([("q", 0, sr, [0.0] * sr)], "job_id string, part_idx int, sr int, samples array<float>")
    assert audio.final_metrics(quiet).first().integrated_lufs is None


@pytest.mark.parametrize(("old", "new"), [(48_000, 16_000), (44_100, 16_000), (22_050, 8_000), (16_000, 24_000)])
def test_rates_change_without_aliases(spark, old, new):
    def level(hz):
        df = spark.createDataFrame([("j", 0, old, [float(v) for v in sine(hz, 0.5, 0.5, old)])], "job_id string, seg_idx int, sr int, samples array<float>")
        y = np.array(audio.convert(df, new).first().samples)
        assert y.size == round(old * 0.5 * new / old)
        inner = y[y.size // 4 : -y.size // 4]
        return 20 * np.log10(np.sqrt((inner**2).mean()) / (0.5 / np.sqrt(2)) + 1e-12), y

    assert abs(level(0.2 * min(old, new))[0]) < 0.05
    if new < old:  # above the new half rate: 60 dB or more below
        assert max(level(hz)[0] for hz in (0.505 * new, 0.6 * new, 0.45 * old)) < -60
    y = level(440)[1]
    assert np.abs(y - sine(440, 0.5, 0.5, new))[200:-200].max() < 2e-3
    assert np.array_equal(audio.resampled(np.ones(50), old, new), np.ones(round(50 * new / old))) or np.allclose(audio.resampled(np.ones(50), old, new), 1)


def test_signals_are_measured_once(spark):
    clips = spark.createDataFrame([("j", 0, 8000, sine(200, 1).tolist())], "job_id string, seg_idx int, sr int, samples array<float>")
    found = audio.final_metrics(audio.join_clips(clips))
    assert found._jdf.queryExecution().toString().count("MapInPandas") == 0 and found.count() == 1
