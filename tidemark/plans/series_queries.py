"""Queries over ``events`` (user: recording, value: magnitude), ``lineitem`` and ``conversations`` as time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY, HOUR, micros
from tidemark.operators import segments as S
from tidemark.operators import windows as W

from .catalogue import register

E = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value, event_type FROM events)"
GAP, HIT = 6 * HOUR, 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("us"), "value", "event_type")


def r(c, n: int = 6):
    return F.round(c, n)


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = events(spark, sf_dir).where(F.col("value") > HIT)
    return S.sessionize(hits, "user_id", "us", GAP, {"total": ("sum", F.col("value")), "top": ("max", F.col("value"))})


BOUTS = f"""{E}, h AS (SELECT *, CASE WHEN us - lag(us) OVER w > {GAP} THEN 1 WHEN lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WHERE value > {HIT} WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS session FROM h),
b AS (SELECT user_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n, sum(value) AS total, max(value) AS top FROM s GROUP BY user_id, session)"""


@register(
    "bout_sessionize",
    f"WITH {BOUTS} SELECT user_id, CAST(session AS BIGINT) AS session, start_us, end_us, n, round(total, 4) AS total, top FROM b",
)
def bout_sessionize(spark, sf_dir):
    return bouts(spark, sf_dir).select("user_id", F.col("session").cast("long"), "start_us", "end_us", "n", r("total", 4).alias("total"), "top")


@register("movement_threshold_global", "SELECT round(greatest(avg(value) + stddev_pop(value), 0.1), 6) AS threshold FROM events")
def movement_threshold_global(spark, sf_dir):
    return events(spark, sf_dir).agg(r(F.greatest(F.avg("value") + F.stddev_pop("value"), F.lit(0.1))).alias("threshold"))


RUNS = """f AS (SELECT *, CASE WHEN lag(flag) OVER w = flag THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY k ORDER BY t)),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) AS run FROM f)"""


@register(
    "segment_runs",
    f"WITH {E}, src AS (SELECT user_id AS k, us AS t, value > 100 AS flag FROM e), {RUNS.format(src='src')} "
    f"SELECT k AS user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n, round((max(t) - min(t)) / {HOUR}, 6) AS hours FROM g WHERE flag GROUP BY k, run",
)
def segment_runs(spark, sf_dir):
    found = S.runs(events(spark, sf_dir), "user_id", "us", F.col("value") > 100)
    return found.withColumn("hours", r((F.col("end_us") - F.col("start_us")) / HOUR))


@register(
    "segment_runs_roles",
    "WITH src AS (SELECT conv_id AS k, turn AS t, role = 'user' AS flag FROM conversations), " + RUNS.format(src="src") + " "
    "SELECT k AS conv_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM g WHERE flag GROUP BY k, run",
)
def segment_runs_roles(spark, sf_dir):
    return S.runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", bucket=1 << 40)


MERGED = f"""{BOUTS}, kept AS (SELECT * FROM b WHERE end_us - start_us >= {HOUR}),
m AS (SELECT *, CASE WHEN start_us - max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM kept),
mg AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start_us, end_us) AS g FROM m),
iv AS (SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS parts FROM mg GROUP BY user_id, g)"""


def merged(spark, sf_dir):
    return S.merge_gaps(bouts(spark, sf_dir), "user_id", 12 * HOUR, HOUR)


@register("merge_short_gaps", f"WITH {MERGED} SELECT user_id, start_us, end_us, parts FROM iv")
def merge_short_gaps(spark, sf_dir):
    return merged(spark, sf_dir)


def _night(day: str) -> str:
    return f"greatest(least(end_us, {day} + {33 * HOUR}) - greatest(start_us, {day} + {22 * HOUR}), 0) / {HOUR}.0"


NIGHT = f"""CASE WHEN start_us // {DAY} = end_us // {DAY} THEN {_night(f"(start_us // {DAY}) * {DAY} - {DAY}")} + {_night(f"(start_us // {DAY}) * {DAY}")}
 WHEN end_us // {DAY} = start_us // {DAY} + 1 THEN {_night(f"(start_us // {DAY}) * {DAY}")} ELSE 0.0 END"""


@register("night_overlap_hours", f"WITH {MERGED} SELECT user_id, start_us, round(CAST({NIGHT} AS DOUBLE), 6) AS night_h FROM iv")
def night_overlap_hours(spark, sf_dir):
    return merged(spark, sf_dir).select("user_id", "start_us", r(S.night_overlap_hours(F.col("start_us"), F.col("end_us"))).alias("night_h"))


NIGHTS = f"""{MERGED}, nights AS (SELECT user_id, start_us, end_us, CAST({NIGHT} AS DOUBLE) AS night_h FROM iv
 WHERE {NIGHT} >= 2 AND end_us - start_us > {4 * HOUR})"""


def nights(spark, sf_dir):
    return S.select_nights(merged(spark, sf_dir), "user_id")


@register(
    "select_nights",
    f"WITH {NIGHTS} SELECT user_id, start_us, end_us, round(night_h, 6) AS night_h, row_number() OVER (PARTITION BY user_id ORDER BY start_us) - 1 AS night FROM nights",
)
def select_nights(spark, sf_dir):
    return nights(spark, sf_dir).select("user_id", "start_us", "end_us", r("night_h").alias("night_h"), F.col("night").cast("long"))


SLICED = f"""{E}, fst AS (SELECT user_id, min(us) AS first FROM e GROUP BY user_id),
sl AS (SELECT e.*, greatest((us - {12 * HOUR}) // {DAY} - (first - {12 * HOUR}) // {DAY} - CASE WHEN first % {DAY} < {12 * HOUR} THEN 1 ELSE 0 END, 0) AS slice FROM e JOIN fst USING (user_id))"""


def sliced(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min("us").alias("first"))
    return e.join(first, "user_id").withColumn("slice", W.noon_slice(F.col("us"), F.col("first")))


@register("noon_day_slices", f"WITH {SLICED} SELECT user_id, slice, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM sl GROUP BY user_id, slice")
def noon_day_slices(spark, sf_dir):
    return sliced(spark, sf_dir).groupBy("user_id", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@register(
    "percentile_threshold_runs",
    f"""WITH {SLICED}, lim AS (SELECT user_id, slice, quantile_cont(value, 0.1) * 4 AS lim FROM sl GROUP BY user_id, slice),
f AS (SELECT sl.user_id, sl.slice, us, value >= 0 AND value < lim AS f FROM sl JOIN lim USING (user_id, slice)),
g AS (SELECT *, lead(us) OVER w AS nxt, CASE WHEN lag(f) OVER w = f THEN 0 ELSE 1 END AS new, min(f::INT) OVER (PARTITION BY user_id, slice) AS every FROM f WINDOW w AS (PARTITION BY user_id, slice ORDER BY us)),
h AS (SELECT *, sum(new) OVER (PARTITION BY user_id, slice ORDER BY us) AS run FROM g)
SELECT user_id, slice, min(us) AS start_us, max(coalesce(nxt, us)) AS end_us, count(*) AS n FROM h WHERE f AND every = 0 GROUP BY user_id, slice, run""",
)
def percentile_threshold_runs(spark, sf_dir):
    return W.threshold_runs(sliced(spark, sf_dir), ["user_id", "slice"], "us", "value", 0.1, 4.0)


TUMBLED = f"""{E}, fst AS (SELECT user_id, min(us) AS first FROM e GROUP BY user_id),
tw AS (SELECT user_id, (us - first) // {DAY} AS win, any_value(first) AS first, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM e JOIN fst USING (user_id) GROUP BY user_id, (us - first) // {DAY})"""


@register(
    "tumbling_stationary_windows",
    f'WITH {TUMBLED} SELECT user_id, win AS "window", first + win * {DAY} AS start_us, n, round(mean, 6) AS mean_value, round(std, 6) AS std_value FROM tw',
)
def tumbling_stationary_windows(spark, sf_dir):
    t = W.tumbling_windows(events(spark, sf_dir), "user_id", "us", DAY, ["value"])
    return t.select("user_id", "window", "start_us", "n", r("mean_value").alias("mean_value"), r("std_value").alias("std_value"))


@register(
    "nonwear_intervals",
    f"""WITH {TUMBLED}, calm AS (SELECT *, win - row_number() OVER (PARTITION BY user_id ORDER BY win) AS g FROM tw WHERE std < 90)
SELECT user_id, min(first + win * {DAY}) AS start_us, max(first + win * {DAY}) AS end_us, count(*) AS windows FROM calm GROUP BY user_id, g HAVING max(win) - min(win) > 1""",
)
def nonwear_intervals(spark, sf_dir):
    t = W.tumbling_windows(events(spark, sf_dir), "user_id", "us", DAY, ["value"])
    return W.nonwear(t, "user_id", ["value"], 90, DAY)


@register(
    "interval_mask_annotate",
    f"WITH {NIGHTS} SELECT event_id, user_id, EXISTS (SELECT 1 FROM nights n WHERE n.user_id = e.user_id AND e.us BETWEEN n.start_us AND n.end_us) AS sptw FROM e",
)
def interval_mask_annotate(spark, sf_dir):
    return S.in_intervals(events(spark, sf_dir), nights(spark, sf_dir), "user_id", "us", "sptw").select("event_id", "user_id", "sptw")


@register(
    "max_overlap_match",
    f"""WITH {NIGHTS}, pr AS (SELECT n.user_id, n.start_us, n.end_us, b.start_us AS bs, b.end_us AS be,
 least(n.end_us, b.end_us + 120000000) - greatest(n.start_us, b.start_us - 120000000) AS ov FROM nights n JOIN b ON b.user_id = n.user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, start_us, end_us ORDER BY ov DESC, bs, be) AS rn FROM pr WHERE ov > 0)
SELECT n.user_id, n.start_us, n.end_us, coalesce(ov, 0) AS overlap_us, bs AS match_start_us, be AS match_end_us, coalesce(ov, 0) >= 0.5 * (n.end_us - n.start_us) AND coalesce(ov, 0) > 0 AS matched
FROM nights n LEFT JOIN rk ON rk.user_id = n.user_id AND rk.start_us = n.start_us AND rk.end_us = n.end_us AND rn = 1""",
)
def max_overlap_match(spark, sf_dir):
    return S.max_overlap(nights(spark, sf_dir), bouts(spark, sf_dir), "user_id")


def _hour(x: str) -> str:
    return f"(({x} % {DAY}) // {HOUR})"


@register(
    "conflict_rules",
    f"""WITH {MERGED}, bd AS (SELECT user_id, min(us) AS f, max(us) AS l FROM e GROUP BY user_id),
w AS (SELECT r.user_id, r.start_us AS s, r.end_us AS e2, f, l, min(struct_pack(ws := v.start_us, we := v.end_us)) AS w FROM b r JOIN bd USING (user_id)
 LEFT JOIN iv v ON v.user_id = r.user_id AND v.start_us <= r.start_us AND r.end_us <= v.end_us GROUP BY r.user_id, r.start_us, r.end_us, f, l),
c AS (SELECT *, w.ws AS ws, w.we AS we, (e2 - s) / {HOUR}.0 AS len, ({_hour('s')} >= 22 OR {_hour('s')} < 9) AND ({_hour('e2')} >= 22 OR {_hour('e2')} < 9) AS nt,
 w.we // {DAY} > w.ws // {DAY} OR {_hour('w.we')} < {_hour('w.ws')} AS ov FROM w),
d AS (SELECT *, CASE WHEN ws IS NULL THEN 'none' WHEN s < f + {4 * HOUR} THEN 'R1' WHEN e2 > l - {4 * HOUR} AND ov AND len > 4 THEN 'R2a' WHEN e2 > l - {4 * HOUR} THEN 'R2b'
 WHEN nt AND len < 4 THEN 'R3' WHEN NOT nt AND ({_hour('s')} < 9 OR {_hour('e2')} > 22) THEN 'R4' WHEN NOT nt AND ((ov AND len > 4) OR NOT ov) THEN 'R5' WHEN NOT nt AND ov AND len < 4 THEN 'R6' ELSE 'none' END AS rule FROM c)
SELECT user_id, s AS start_us, e2 AS end_us, rule, CASE WHEN rule = 'R1' THEN f WHEN rule IN ('R2a', 'R5') THEN ws WHEN rule = 'R2b' THEN (l // {DAY}) * {DAY} + {8 * HOUR} WHEN rule IN ('R4', 'R6') THEN s END AS clear_from_us,
 CASE WHEN rule IN ('R1', 'R4', 'R6') THEN e2 WHEN rule IN ('R2a', 'R5') THEN we WHEN rule = 'R2b' THEN l END AS clear_to_us, rule = 'R3' AS set_wear FROM d""",
)
def conflict_rules(spark, sf_dir):
    bounds = W.recording_bounds(events(spark, sf_dir), "user_id", "us").drop("n")
    return S.conflict_rules(bouts(spark, sf_dir).select("user_id", "start_us", "end_us"), merged(spark, sf_dir), bounds, "user_id")


@register(
    "sptw_stats",
    f"""WITH {MERGED}, p AS (SELECT iv.user_id, iv.start_us, iv.end_us, b.start_us AS bs, b.end_us AS be FROM iv JOIN b ON b.user_id = iv.user_id AND b.start_us >= iv.start_us AND b.end_us <= iv.end_us),
a AS (SELECT user_id, start_us, end_us, count(*) AS bouts, sum(round((be - bs) / 60000000.0)) AS mins, min(bs) AS onset, max(be) AS wake FROM p GROUP BY user_id, start_us, end_us)
SELECT user_id, start_us, end_us, bouts, round((end_us - start_us) / {HOUR}.0, 6) AS duration_h, round(mins / 60, 6) AS sleep_h, round(mins / ((end_us - start_us) / 60000000.0), 6) AS efficiency,
 round(((wake - onset) / 60000000.0 - mins) / 60, 6) AS waso_h FROM a""",
)
def sptw_stats(spark, sf_dir):
    s = S.window_stats(merged(spark, sf_dir), bouts(spark, sf_dir), "user_id")
    return s.select("user_id", "start_us", "end_us", "bouts", *[r(c).alias(c) for c in ("duration_h", "sleep_h", "efficiency", "waso_h")])


GAPS = f"{E}, gp AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e)"


@register(
    "sample_rate_infer",
    f"""WITH {GAPS}, q AS (SELECT user_id, round(3600 / avg(gap / 1000000.0), 2) AS per_hour, count(*) AS n_gaps, min(gap) = max(gap) AS uniform FROM gp WHERE gap > 0 AND gap <= {24 * HOUR} GROUP BY user_id)
SELECT user_id, CAST(per_hour AS DOUBLE) AS per_hour, uniform, n_gaps, CAST(CASE WHEN per_hour * 100 < 5 THEN per_hour * 100 WHEN (per_hour * 100) % 10 < 5 THEN floor(per_hour * 10) * 10 ELSE ceil(per_hour * 10) * 10 END AS DOUBLE) AS target FROM q""",
)
def sample_rate_infer(spark, sf_dir):
    # The events' clock runs in hours where a sensor's runs in seconds.
    slow = events(spark, sf_dir).withColumn("us", F.col("us") / 3600)
    found = W.sample_rate(slow, "user_id", "us", 24 * 1_000_000)
    return found.select("user_id", F.col("rate_hz").alias("per_hour"), "uniform", "n_gaps", W.target_rate(F.col("rate_hz") * 100).alias("target"))


@register(
    "drop_all_duplicates",
    "SELECT l_suppkey, epoch_us(l_shipdate) AS us, any_value(l_orderkey) AS l_orderkey, any_value(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) = 1",
)
def drop_all_duplicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", micros("l_shipdate").alias("us"), "l_orderkey", "l_quantity")
    return W.drop_all_duplicates(li, "l_suppkey", "us")


@register(
    "nearest_resample",
    f"""WITH {E}, fst AS (SELECT user_id, min(us) AS f, max(us) AS l FROM e GROUP BY user_id),
tk AS (SELECT user_id, unnest(range(0, (l - f) // {HOUR} + 1)) AS tick, f FROM fst), tt AS (SELECT user_id, tick, f + tick * {HOUR} AS t FROM tk),
p AS (SELECT tt.user_id, tick, t, e.us AS pu, e.value AS pv FROM tt ASOF LEFT JOIN e ON tt.user_id = e.user_id AND tt.t >= e.us),
n AS (SELECT p.*, e.us AS nu, e.value AS nv FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t <= e.us)
SELECT user_id, tick, t AS tick_us, CASE WHEN nu IS NULL OR t - pu <= nu - t THEN pu ELSE nu END AS source_us, CASE WHEN nu IS NULL OR t - pu <= nu - t THEN pv ELSE nv END AS value FROM n""",
)
def nearest_resample(spark, sf_dir):
    return W.nearest_resample(events(spark, sf_dir), "user_id", "us", ["value"], HOUR)


@register(
    "truncate_days",
    f"WITH {E}, fst AS (SELECT user_id, min(us) AS f FROM e GROUP BY user_id) SELECT user_id, count(*) AS n, min(us) AS start_us, max(us) AS last_us FROM e JOIN fst USING (user_id) WHERE us <= f + {7 * DAY} GROUP BY user_id",
)
def truncate_days(spark, sf_dir):
    t = W.truncate_days(events(spark, sf_dir), "user_id", "us", 7)
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("last_us"))


@register(
    "logging_bounds",
    f"""WITH {E}, gp AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e)
SELECT user_id, min(us) AS start_us, max(us) + CAST(round(coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0), 0)) AS BIGINT) AS end_us FROM gp GROUP BY user_id""",
)
def logging_bounds(spark, sf_dir):
    return W.logging_end(events(spark, sf_dir), "user_id", "us")


@register(
    "forward_median",
    f"""WITH {E} SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN round(quantile_cont(value, 0.5) OVER w, 6) END AS median FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
)
def forward_median(spark, sf_dir):
    return W.forward_median(events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 5, "m").select("event_id", r("m").alias("median"))


@register(
    "zangle_change",
    """WITH o AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i FROM lineitem),
m AS (SELECT l_suppkey, i, count(*) OVER w AS c, quantile_cont(x, 0.5) OVER w AS x, quantile_cont(y, 0.5) OVER w AS y, quantile_cont(z, 0.5) OVER w AS z FROM o
 WINDOW w AS (PARTITION BY l_suppkey ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ep AS (SELECT l_suppkey, i // 5 AS epoch, avg(degrees(atan2(z, sqrt(x * x + y * y)))) AS angle FROM m WHERE c = 5 GROUP BY l_suppkey, i // 5)
SELECT l_suppkey, epoch, round(angle, 4) AS angle, round(coalesce(abs(angle - lag(angle) OVER (PARTITION BY l_suppkey ORDER BY epoch)), 0), 4) AS change FROM ep""",
)
def zangle_change(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z")
    )
    c = W.z_angle_change(li, "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], ("x", "y", "z"), 5)
    return c.select("l_suppkey", "epoch", r("angle", 4).alias("angle"), r("change", 4).alias("change"))


@register(
    "extrema_downsample",
    f"""WITH {E}, bn AS (SELECT *, us // {DAY * 7} AS p, ((us % {DAY * 7}) * 40) // {DAY * 7} AS s FROM e),
pk AS (SELECT user_id, arg_min(us, (value, us)) AS us FROM bn GROUP BY user_id, p, s UNION SELECT user_id, arg_min(us, (-value, us)) FROM bn GROUP BY user_id, p, s
 UNION SELECT user_id, min(us) FROM bn GROUP BY user_id, p UNION SELECT user_id, max(us) FROM bn GROUP BY user_id, p)
SELECT event_id, e.user_id, e.us, value FROM e JOIN pk ON pk.user_id = e.user_id AND pk.us = e.us""",
)
def extrema_downsample(spark, sf_dir):
    e = events(spark, sf_dir)
    return W.extrema_downsample(e, "user_id", "us", ["value"], 40, 7 * DAY).select("event_id", "user_id", "us", "value")


@register(
    "wear_summary",
    f"WITH {GAPS} SELECT user_id, count(*) AS n, round(coalesce(sum(gap) FILTER (gap < {24 * HOUR}), 0) / {HOUR}.0, 6) AS wear_h FROM gp GROUP BY user_id",
)
def wear_summary(spark, sf_dir):
    g = W.sample_gaps(events(spark, sf_dir), "user_id", "us")
    wear = F.coalesce(F.sum(F.when(F.col("gap") < 24 * HOUR, F.col("gap"))), F.lit(0)) / HOUR
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r(wear).alias("wear_h"))


@register("day_chunks", f"WITH {E}, fst AS (SELECT user_id, min(us) AS f FROM e GROUP BY user_id) SELECT user_id, (us - f) // {5 * DAY} AS chunk, count(*) AS n FROM e JOIN fst USING (user_id) GROUP BY user_id, (us - f) // {5 * DAY}")
def day_chunks(spark, sf_dir):
    return W.tumbling_windows(events(spark, sf_dir), "user_id", "us", 5 * DAY, ["value"]).select("user_id", F.col("window").alias("chunk"), "n")
