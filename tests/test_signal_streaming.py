"""Signal operators against numpy, slicer edge cases, streams against batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaframe.operators import signal as S


def np_rms(y, frame, hop):
    pad = frame // 2
    y = np.pad(y, (pad, pad))
    n = 1 + (len(y) - frame) // hop
    return np.array([np.sqrt(np.mean(y[t * hop:t * hop + frame] ** 2)) for t in range(n)])


def _signal_df(spark, arrays):
    rows = [(sid, i, float(v)) for sid, arr in arrays.items() for i, v in enumerate(arr)]
    return spark.createDataFrame(rows, "signal_id long, pos long, v double")


def test_frame_rms_matches_numpy(spark):
    rng = np.random.default_rng(0)
    arrays = {1: rng.normal(size=37), 2: rng.normal(size=5), 3: np.array([0.5])}
    got = S.frame_rms(_signal_df(spark, arrays), frame_length=8, hop_length=3).collect()
    for sid, arr in arrays.items():
        mine = sorted((r["frame"], r["rms"]) for r in got if r["signal_id"] == sid)
        ref = np_rms(arr, 8, 3)
        assert [f for f, _ in mine] == list(range(len(ref)))
        assert np.allclose([x for _, x in mine], ref)


CFG = S.SlicerConfig(sr=100, threshold=-20, min_length=300, min_interval=100, hop_size=10, max_sil_kept=200)


@pytest.mark.parametrize("name,arr,expect_clips", [
    ("all_loud", np.ones(200), 1),
    ("all_silent", np.zeros(200), 0),          # the whole signal is one trailing cut: no clip
    ("one_sample", np.array([1.0]), 1),
    ("long_gap", np.concatenate([np.ones(60), np.zeros(80), np.ones(60)]), 2),
    ("lead_trail", np.concatenate([np.zeros(40), np.ones(100), np.zeros(40)]), 1),
])
def test_slicer_edges(spark, name, arr, expect_clips):
    clips = S.slice_signals(_signal_df(spark, {1: arr}), CFG).collect()
    assert len(clips) == expect_clips, name
    for c in clips:
        assert 0 <= c["start"] < c["end"] <= len(arr)


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_spectrum_matches_numpy(spark, chunk):
    y = np.sin(np.arange(40) / 3.0)
    spec = S.frame_spectrum(_signal_df(spark, {1: y}), n_fft=8, hop=2, win=8,
                            chunk_frames=chunk).orderBy("frame").collect()
    pad = (8 - 2) // 2
    yp = np.pad(y, (pad, pad), mode="reflect")
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8)
    ref = [np.sqrt(np.abs(np.fft.rfft(yp[t * 2:t * 2 + 8] * win)) ** 2 + 1e-6) for t in range(1 + (len(yp) - 8) // 2)]
    assert len(spec) == len(ref)
    assert np.allclose(np.array([r["mag"] for r in spec]), np.array(ref))


def test_streams_equal_batch_twins(spark):
    import __spark_entry__ as E
    from sonaframe.registry.filters import exit_marked
    from sonaframe.operators.filters import turns_until_exit
    from sonaframe.streaming import gap_segments_batch
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    s3 = {tuple(r) for r in q["stream_turns_until_exit"](spark, sf).collect()}
    b3 = {tuple(r) for r in turns_until_exit(exit_marked(spark, sf)).select("conv_id", "turn", "text").collect()}
    assert s3 == b3
    s2 = {tuple(r) for r in q["stream_gap_segments"](spark, sf).collect()}
    ev = spark.read.parquet(f"{sf}/events.parquet")
    b2 = {tuple(r) for r in gap_segments_batch(ev, 6 * 3600).select("user_id", "start_us", "end_us", "n_events").collect()}
    assert s2 == b2


def test_ingest_stream_restart_skips_done_files(spark, tmp_path):
    from sonaframe.streaming import stream_ingest_labels
    inp, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a.wav|s|en|hi",), ("b.wav|s|fr|salut",), ("bad|line",)], "value string") \
        .coalesce(1).write.text(inp)
    stream_ingest_labels(spark, inp, out)
    first = spark.read.parquet(out + "/accepted").count(), spark.read.parquet(out + "/rejected").count()
    assert first == (1, 2)
    stream_ingest_labels(spark, inp, out)              # same checkpoint: nothing new to process
    again = spark.read.parquet(out + "/accepted").count(), spark.read.parquet(out + "/rejected").count()
    assert again == first
    spark.createDataFrame([("c.wav|s|EN|more",)], "value string").coalesce(1).write.mode("append").text(inp)
    stream_ingest_labels(spark, inp, out)              # only the new file is read
    assert spark.read.parquet(out + "/accepted").count() == 2


def test_frame_rms_block_path_matches_numpy(spark):
    rng = np.random.default_rng(3)
    arrays = {1: rng.normal(size=53), 2: rng.normal(size=3)}
    got = S.frame_rms(_signal_df(spark, arrays), frame_length=8, hop_length=2).collect()   # 8 % 2 == 0: block path
    for sid, arr in arrays.items():
        mine = sorted((r["frame"], r["rms"]) for r in got if r["signal_id"] == sid)
        ref = np_rms(arr, 8, 2)
        assert [f for f, _ in mine] == list(range(len(ref)))
        assert np.allclose([x for _, x in mine], ref)


def test_peak_gate_nan_and_spectrum_filterbank(spark):
    sig = spark.createDataFrame([(1, 0, 0.5), (1, 1, float("nan")), (2, 0, 3.0), (3, 0, 1.0)],
                                "signal_id long, pos long, v double")
    reasons = {r["signal_id"]: r["reject_reason"] for r in S.peak_gate(sig).collect()}
    assert reasons == {1: "nan", 2: "peak", 3: None}
    y = np.cos(np.arange(30) / 2.0)
    basis = np.abs(np.random.default_rng(1).normal(size=(3, 5)))      # 3 bands over 5 rfft bins (n_fft 8)
    spec = S.frame_spectrum(_signal_df(spark, {1: y}), n_fft=8, hop=2, win=8, mel_basis=basis, log=True,
                            chunk_frames=4).orderBy("frame").collect()
    plain = S.frame_spectrum(_signal_df(spark, {1: y}), n_fft=8, hop=2, win=8).orderBy("frame").collect()
    ref = np.log(np.maximum(np.array([r["mag"] for r in plain]) @ basis.T, 1e-5))
    assert np.allclose(np.array([r["mag"] for r in spec]), ref)


def _states(spark, monkeypatch):
    """Collects, for every run of a query, the rows that its state holds at the end."""
    from sonaframe.streaming import jobs
    seen, run = [], jobs._run

    def watched(writer, *a):
        q = run(writer, *a)
        seen.append([p["numInputRows"] for p in q.recentProgress] + [sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])])
        return q

    monkeypatch.setattr(jobs, "_run", watched)
    return seen


def test_turns_arrive_in_any_order_over_batches(spark, tmp_path, monkeypatch):
    """Shuffled batches equal the batch operator; after the input's end nothing is left in state."""
    import datetime
    import random

    from sonaframe.operators.filters import turns_until_exit
    from sonaframe.streaming import jobs
    r = random.Random(4)
    at = datetime.datetime(2024, 1, 1)
    rows = [(c, t, "EXIT" if t == c % 9 else r.choice(("hi", "", None, "exit now")), at + datetime.timedelta(minutes=3 * c, seconds=t)) for c in range(30) for t in range(7)]
    schema = "conv_id long, turn long, text string, ts timestamp_ntz"
    want = {tuple(x) for x in turns_until_exit(spark.createDataFrame(rows, schema)).select("conv_id", "turn", "text").collect()}
    r.shuffle(rows)
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    seen = _states(spark, monkeypatch)
    out = jobs.stream_turns_until_exit(spark, src, str(tmp_path / "out"), glob="*.parquet", watermark="2 days", files_per_batch=1)
    got = [tuple(x) for x in spark.read.parquet(out).select("conv_id", "turn", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    assert sum(seen[0][:-1]) == len(rows) and sum(seen[1][:-1]) == 1
    assert seen[0][-1] > 0 and seen[1][-1] == 0
    # a rerun finds nothing new
    jobs.stream_turns_until_exit(spark, src, str(tmp_path / "out"), glob="*.parquet", watermark="2 days")
    assert spark.read.parquet(out).count() == len(want)


def test_turns_later_than_the_watermark_are_dropped(spark, tmp_path):
    import datetime

    from sonaframe.streaming import jobs
    at = datetime.datetime(2024, 1, 1)
    schema = "conv_id long, turn long, text string, ts timestamp_ntz"
    src = str(tmp_path / "in")
    for k, rows in enumerate([[(1, 0, "a", at), (2, 0, "x", at + datetime.timedelta(hours=9))],
                              [(1, 1, "late", at + datetime.timedelta(minutes=1)), (2, 1, "exit", at + datetime.timedelta(hours=10))],
                              [(2, 2, "after", at + datetime.timedelta(hours=11)), (3, 0, None, at + datetime.timedelta(hours=30))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = jobs.stream_turns_until_exit(spark, src, str(tmp_path / "out"), glob="*.parquet", watermark="1 hour", finite=k == 2)
    assert sorted(tuple(x) for x in spark.read.parquet(out).select("conv_id", "turn", "text").collect()) == [(1, 0, "a"), (2, 0, "x")]


def test_sessions_are_closed_by_the_end_of_the_input(spark, tmp_path, monkeypatch):
    """The events are read once; null keys and out-of-order files are sessions like others."""
    import datetime
    import random

    from sonaframe.streaming import gap_segments_batch, jobs
    r = random.Random(5)
    at = datetime.datetime(2024, 1, 1)
    rows = [(r.choice((1, 2, 3, None)), at + datetime.timedelta(seconds=r.randrange(240_000)), i) for i in range(300)]
    schema = "user_id long, ts timestamp_ntz, event_id long"
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(src)
    seen = _states(spark, monkeypatch)
    out = jobs.stream_gap_segments(spark, src, str(tmp_path / "out"), gap="45 minutes", glob="*.parquet", watermark="5 days", files_per_batch=1)
    cols = ["user_id", "start_us", "end_us", "n_events"]
    got = sorted((tuple(x) for x in spark.read.parquet(out).select(*cols).collect()), key=str)
    want = sorted((tuple(x) for x in gap_segments_batch(spark.createDataFrame(rows, schema), 45 * 60).select(*cols).collect()), key=str)
    assert got == want and len(got) > 20
    assert sum(seen[0][:-1]) == len(rows) and sum(seen[1][:-1]) == 1 and seen[1][-1] <= 1
