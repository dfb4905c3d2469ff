"""Registered signal operators (F7, A3-A5, W7, W8, R12) on events as signals.

A user's events ordered by (ts, event_id) form one signal; ``v = value / 100``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as S
from ..util.rank import rank_within
from . import sql
from .base import r6, register, table

SIG_SQL = """
sig AS (SELECT user_id AS signal_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
               value / 100.0 AS v, event_id FROM events)"""

FRAME, HOP = 4, 2


def signals(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ranked = rank_within(ev, ["user_id"], [F.col("ts"), F.col("event_id")], "_p")
    return ranked.select(F.col("user_id").alias("signal_id"), (F.col("_p") - 1).cast("long").alias("pos"),
                         (F.col("value") / 100.0).alias("v"), "event_id")


@register("peak_gate", f"""
WITH {SIG_SQL}
SELECT signal_id, {sql.r6('max(abs(v))')} AS peak, count(*) AS n,
       CASE WHEN bool_or(isnan(v)) THEN 'nan' WHEN max(abs(v)) > 2.2 THEN 'peak' WHEN max(abs(v)) = 0 THEN 'silent' END AS reject_reason
FROM sig GROUP BY signal_id""")
def q_peak_gate(spark, sf):
    g = S.peak_gate(signals(spark, sf))
    return g.select("signal_id", r6("peak").alias("peak"), "n", "reject_reason")


@register("peak_blend", f"""
WITH {SIG_SQL},
p AS (SELECT signal_id, max(abs(v)) AS peak FROM sig GROUP BY 1 HAVING NOT bool_or(isnan(v)) AND max(abs(v)) <= 2.2 AND max(abs(v)) > 0)
SELECT event_id, {sql.r6('v / peak * (0.95 * 0.5 * 32768.0) + (1 - 0.5) * 32768.0 * v')} AS v_out
FROM sig JOIN p USING (signal_id)""")
def q_peak_blend(spark, sf):
    b = S.peak_blend(signals(spark, sf))
    return b.select("event_id", r6("v_out").alias("v_out"))


@register("slice_blend", f"""
WITH {SIG_SQL},
p AS (SELECT signal_id, max(abs(v)) AS peak FROM sig GROUP BY 1),
o AS (SELECT event_id, peak, CASE WHEN peak > 1 THEN v / peak ELSE v END AS v1 FROM sig JOIN p USING (signal_id)),
b AS (SELECT event_id, CASE WHEN peak = 0 THEN 0.0 ELSE v1 / peak END * (0.9 * 0.25) + (1 - 0.25) * v1 AS x FROM o)
SELECT event_id, {sql.r6('x')} AS v_out,
       CAST(least(greatest(CASE WHEN x * 32767 >= 0 THEN floor(x * 32767) ELSE ceil(x * 32767) END, -32768), 32767) AS INTEGER) AS i16
FROM b""")
def q_slice_blend(spark, sf):
    return S.slice_blend(signals(spark, sf)).select("event_id", r6("v_out").alias("v_out"), "i16")


@register("clip_guard", f"""
WITH {SIG_SQL},
p AS (SELECT signal_id, max(abs(v)) AS peak FROM sig GROUP BY 1),
o AS (SELECT event_id, CASE WHEN peak > 1 THEN v / peak ELSE v END AS v1 FROM sig JOIN p USING (signal_id))
SELECT event_id, {sql.r6('v1')} AS v_out,
       CAST(least(greatest(CASE WHEN v1 * 32768 >= 0 THEN floor(v1 * 32768) ELSE ceil(v1 * 32768) END, -32768), 32767) AS INTEGER) AS i16
FROM o""")
def q_clip_guard(spark, sf):
    c = S.clip_guard(signals(spark, sf))
    return c.select("event_id", r6("v_out").alias("v_out"), "i16")


FRAMES_SQL = f"""
x AS (SELECT signal_id, unnest(generate_series(CAST(greatest(0, ceil((pos + {FRAME // 2} - {FRAME - 1}) / {HOP})) AS BIGINT),
                                               CAST(floor((pos + {FRAME // 2}) / {HOP}) AS BIGINT))) AS frame,
             v * v AS sq FROM sig),
nn AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1),
s AS (SELECT signal_id, frame, sum(sq) AS s FROM x GROUP BY 1, 2),
rms AS (SELECT s.signal_id, s.frame, sqrt(s.s / {float(FRAME)}) AS rms FROM s JOIN nn USING (signal_id)
        WHERE frame <= floor((n + {2 * (FRAME // 2) - FRAME}) / {HOP}))"""


def _rms(spark, sf):
    return S.frame_rms(signals(spark, sf), frame_length=FRAME, hop_length=HOP)


@register("frame_rms", f"""
WITH {SIG_SQL}, {FRAMES_SQL}
SELECT signal_id, frame, {sql.r6('rms')} AS rms FROM rms""")
def q_frame_rms(spark, sf):
    return _rms(spark, sf).select("signal_id", "frame", r6("rms").alias("rms"))


SIL_DB = -20.0


@register("silence_runs", f"""
WITH {SIG_SQL}, {FRAMES_SQL},
sl AS (SELECT signal_id, frame, frame - row_number() OVER (PARTITION BY signal_id ORDER BY frame) AS grp
       FROM rms WHERE rms < {10 ** (SIL_DB / 20.0)!r})
SELECT signal_id, min(frame) AS start, max(frame) AS "end", count(*) AS length FROM sl GROUP BY signal_id, grp""")
def q_silence_runs(spark, sf):
    return S.silence_runs(_rms(spark, sf), threshold_db=SIL_DB).select("signal_id", "start", "end", "length")


SLICER = S.SlicerConfig(sr=50, threshold=SIL_DB, min_length=400, min_interval=100, hop_size=20, max_sil_kept=200)


def _slices_sql(c) -> str:
    """The slicing rules as a walk over the silent runs of each signal (a recursive query)."""
    keep, gap, length, hop = c.frames(c.max_sil_kept), c.frames(c.min_interval), c.frames(c.min_length), c.hop
    low = lambda cond: f"(SELECT arg_min(q.frame, (q.rms, q.frame)) FROM rms q WHERE q.signal_id = r.signal_id AND {cond})"
    return f"""
WITH RECURSIVE {SIG_SQL}, x AS (SELECT signal_id, unnest(generate_series(CAST(greatest(0, ceil((pos + {c.window // 2} - {c.window - 1}) / {hop})) AS BIGINT),
                                               CAST(floor((pos + {c.window // 2}) / {hop}) AS BIGINT))) AS frame, v * v AS sq FROM sig),
nn AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1),
s AS (SELECT signal_id, frame, sum(sq) AS s FROM x GROUP BY 1, 2),
rms AS MATERIALIZED (SELECT s.signal_id, s.frame, sqrt(s.s / {float(c.window)}) AS rms FROM s JOIN nn USING (signal_id)
        WHERE frame <= floor((n + {2 * (c.window // 2) - c.window}) / {hop})),
tt AS (SELECT signal_id, count(*) AS total FROM rms GROUP BY 1),
sl AS (SELECT signal_id, frame, frame - row_number() OVER (PARTITION BY signal_id ORDER BY frame) AS grp FROM rms WHERE rms < {10 ** (c.threshold / 20.0)!r}),
rr AS (SELECT signal_id, min(frame) AS s0, max(frame) + 1 AS i FROM sl GROUP BY signal_id, grp),
r AS MATERIALIZED (SELECT rr.*, total, i >= total AS tail, i - s0 AS len, row_number() OVER (PARTITION BY signal_id ORDER BY s0) AS k FROM rr JOIN tt USING (signal_id)),
w AS MATERIALIZED (SELECT r.*, {low('q.frame BETWEEN r.s0 AND r.i')} AS whole, {low(f'q.frame BETWEEN r.s0 AND least(r.s0 + {keep}, r.i)')} AS lf,
             {low(f'q.frame BETWEEN greatest(r.i - {keep}, r.s0) AND r.i')} AS rt, {low(f'q.frame BETWEEN greatest(r.i - {keep}, r.s0) AND least(r.s0 + {keep}, r.i)')} AS md FROM r),
walk AS (SELECT signal_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS since, [[0]]::BIGINT[][] AS cuts FROM tt
         UNION ALL
         SELECT a.signal_id, w.k, CASE WHEN t.cut IS NULL THEN a.since ELSE t.cut[2] END, CASE WHEN t.cut IS NULL THEN a.cuts ELSE list_append(a.cuts, t.cut) END
         FROM walk a JOIN w ON w.signal_id = a.signal_id AND w.k = a.k + 1, LATERAL (SELECT CASE
           WHEN w.tail THEN CASE WHEN w.len >= {gap} THEN [w.lf, w.total + 1] END
           WHEN NOT ((w.s0 = 0 AND w.i > {keep}) OR (w.len >= {gap} AND w.i - a.since >= {length})) THEN NULL
           WHEN w.len <= {keep} THEN [CASE WHEN w.s0 = 0 THEN 0 ELSE w.whole END, w.whole]
           WHEN w.s0 = 0 THEN [0, w.rt]
           WHEN w.len <= {2 * keep} THEN [least(w.lf, w.md), greatest(w.rt, w.md)]
           ELSE [w.lf, w.rt] END AS cut) t),
f2 AS (SELECT signal_id, any_value(n) AS n, any_value(total) AS total, arg_max(cuts, k)[2:] AS cuts
       FROM walk JOIN nn USING (signal_id) JOIN tt USING (signal_id) GROUP BY signal_id),
sp AS (SELECT signal_id, n, list_zip(list_concat([CAST(0 AS BIGINT)], list_transform(cuts, lambda c: c[2])),
                                     list_concat(list_transform(cuts, lambda c: c[1]), [total])) AS z, cuts FROM f2),
cl AS (SELECT signal_id, n, CASE WHEN n <= {length} THEN [[0, n]] WHEN len(cuts) = 0 THEN [[0, least(z[1][2] * {hop}, n)]]
              ELSE list_transform(list_filter(z, lambda p: p[1] < p[2]), lambda p: [p[1] * {hop}, least(p[2] * {hop}, n)]) END AS c FROM sp),
ex AS (SELECT signal_id, unnest(generate_series(0, len(c) - 1)) AS clip_no, unnest(c) AS p FROM cl)
SELECT signal_id, CAST(clip_no AS BIGINT) AS clip_no, CAST(p[1] AS BIGINT) AS start, CAST(p[2] AS BIGINT) AS "end" FROM ex"""


@register("silence_slices", _slices_sql(SLICER))
def q_silence_slices(spark, sf):
    return S.slice_signals(signals(spark, sf).select("signal_id", "pos", "v"), SLICER)


def _spectrum_sql(n: int = 8, hop: int = 2) -> str:
    """Reflected ends, periodic Hann window, and the DFT as sums of cosines and sines."""
    pad = (n - hop) // 2
    return f"""
WITH {SIG_SQL},
nn AS (SELECT signal_id, count(*) AS n FROM sig GROUP BY 1 HAVING count(*) > {pad}),
fr AS (SELECT signal_id, n, unnest(range(CAST(floor((n + {2 * pad} - {n}) / {hop}) AS BIGINT) + 1)) AS frame FROM nn WHERE n + {2 * pad} >= {n}),
sm AS (SELECT signal_id, frame, j, frame * {hop} + j - {pad} AS q, n FROM fr, range({n}) t(j)),
rx AS (SELECT signal_id, frame, j, CASE WHEN q < 0 THEN -q WHEN q >= n THEN 2 * (n - 1) - q ELSE q END AS pos FROM sm),
y AS (SELECT rx.signal_id, frame, j, v * (0.5 - 0.5 * cos(2 * pi() * j / {n})) AS y FROM rx JOIN sig ON sig.signal_id = rx.signal_id AND sig.pos = rx.pos),
ft AS (SELECT signal_id, frame, k, sum(y * cos(2 * pi() * j * k / {n})) AS re, sum(y * sin(2 * pi() * j * k / {n})) AS im
       FROM y, range({n // 2 + 1}) t(k) GROUP BY 1, 2, 3)
SELECT signal_id, frame, CAST(k AS BIGINT) AS bin, {sql.r6('sqrt(re * re + im * im + 1e-6)')} AS mag FROM ft"""


@register("frame_spectrum", _spectrum_sql())
def q_frame_spectrum(spark, sf):
    spec = S.frame_spectrum(signals(spark, sf), n_fft=8, hop=2, win=8)
    return spec.select("signal_id", "frame", F.posexplode("mag").alias("bin", "mag")).select(
        "signal_id", "frame", F.col("bin").cast("long").alias("bin"), r6("mag").alias("mag"))


MEL = S.MelBands(rate=8000.0, n_fft=16, bands=5, low=50.0, high=3800.0)
MEL_HOP = 8


def _mel_sql(mel: S.MelBands, hop: int) -> str:
    """The filterbank from the rate and the limits, then the spectrum's product with it."""
    def to_mel(hz: float) -> str:
        return f"(CASE WHEN {hz} < 1000.0 THEN {hz} * 3 / 200.0 ELSE 15 + ln({hz} / 1000.0) * 27 / ln(6.4) END)"

    bands = mel.bands
    spectrum = _spectrum_sql(mel.n_fft, hop).rsplit("SELECT signal_id, frame, CAST", 1)[0].rstrip()
    return f"""{spectrum},
em AS (SELECT e, {to_mel(mel.low)} + ({to_mel(mel.high)} - {to_mel(mel.low)}) * e / {bands + 1}.0 AS m FROM range({bands + 2}) t(e)),
ed AS (SELECT e, CASE WHEN m < 15 THEN m * 200 / 3.0 ELSE 1000.0 * exp((m - 15) * ln(6.4) / 27) END AS hz FROM em),
bd AS (SELECT a.e AS band, a.hz AS l, b.hz AS c, d.hz AS r FROM ed a JOIN ed b ON b.e = a.e + 1 JOIN ed d ON d.e = a.e + 2),
wt AS (SELECT band, k, greatest(least((k * {mel.rate} / {mel.n_fft} - l) / (c - l), (r - k * {mel.rate} / {mel.n_fft}) / (r - c)), 0) * 2 / (r - l) AS w
       FROM bd, range({mel.n_fft // 2 + 1}) t(k))
SELECT signal_id, frame, CAST(band AS BIGINT) AS band, {sql.r6('ln(greatest(sum(w * sqrt(re * re + im * im + 1e-6)), 1e-5))')} AS mel
FROM ft JOIN wt USING (k) GROUP BY signal_id, frame, band"""


def _bands(spec, column):
    return spec.select("signal_id", "frame", F.posexplode(column).alias("band", "mel")).select(
        "signal_id", "frame", F.col("band").cast("long").alias("band"), r6("mel").alias("mel"))


@register("mel_spectrum", _mel_sql(MEL, MEL_HOP))
def q_mel_spectrum(spark, sf):
    return _bands(S.mel_spectrum(signals(spark, sf), MEL, hop=MEL_HOP), "mag")


@register("mel_from_spectrum", _mel_sql(MEL, MEL_HOP))
def q_mel_from_spectrum(spark, sf):
    spec = S.frame_spectrum(signals(spark, sf), n_fft=MEL.n_fft, hop=MEL_HOP, win=MEL.n_fft)
    return _bands(spec, S.mel_from_spectrum("mag", MEL))
