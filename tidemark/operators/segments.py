"""Interval algebra: runs, sessions, merging, overlaps, matching, masks and conflict rules.

Times are microseconds.  Runs and sessions are built in two levels: inside time buckets of a
recording, then over the few partial intervals that reach a bucket's edge, so that one long
recording is many tasks' work and never one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY, HOUR, MINUTE, col, day_of, hour_of, time_of_day

#: Length of the buckets that one task sorts.
BUCKET = DAY


def sessionize(df: DataFrame, key: str, ts: str, gap: int, values: dict[str, tuple[str, Column]] | None = None, bucket: int = BUCKET) -> DataFrame:
    """Sessions of each key: a new one starts where the last row is more than ``gap`` before.

    ``values`` maps an output name to (how partial results combine: ``sum``, ``min`` or ``max``; the
    row's value).  Rows with a null key or time are in no session.
    """
    values = {"n": ("sum", F.lit(1).cast("long"))} | (values or {})
    rows = df.select(col(key).alias("_k"), col(ts).alias("_t"), *[v.alias(n) for n, (_, v) in values.items()]).where("_k is not null and _t is not null")
    rows = rows.withColumn("_b", F.floor(F.col("_t") / bucket))
    inside = Window.partitionBy("_k", "_b").orderBy("_t")
    starts = (F.col("_t") - F.lag("_t").over(inside) > gap).cast("int")
    rows = rows.withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("_s", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    aggregates = [combine[how](n).alias(n) for n, (how, _) in values.items()]
    partial = rows.groupBy("_k", "_b", "_s").agg(F.min("_t").alias("start_us"), F.max("_t").alias("end_us"), *aggregates)
    across = Window.partitionBy("_k").orderBy("start_us")
    new = F.coalesce((F.col("start_us") - F.lag("end_us").over(across) > gap).cast("int"), F.lit(1))
    numbered = partial.withColumn("_new", new).withColumn("session", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(F.col("_k").alias(key), "session").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *aggregates
    )


def runs(df: DataFrame, key: str, ts: str, flag: Column, tie: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """Maximal runs of rows whose ``flag`` is true: (key, start_us, end_us, n).

    A run's length is last less first time; a run of one row is kept.  Null flags are false.
    """
    rows = df.select(col(key).alias("_k"), col(ts).alias("_t"), *([col(tie).alias("_o")] if tie else []), F.coalesce(flag, F.lit(False)).alias("_f"))
    rows = rows.where("_k is not null and _t is not null").withColumn("_b", F.floor(F.col("_t") / bucket))
    order = ["_t", *(["_o"] if tie else [])]
    inside = Window.partitionBy("_k", "_b").orderBy(*order)
    changed = F.coalesce((F.lag("_f").over(inside) != F.col("_f")).cast("int"), F.lit(1))
    rows = rows.withColumn("_r", changed).withColumn("_r", F.sum("_r").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    partial = rows.groupBy("_k", "_b", "_r").agg(
        F.first("_f").alias("_f"), F.min("_t").alias("start_us"), F.max("_t").alias("end_us"), F.count(F.lit(1)).alias("n")
    )
    across = Window.partitionBy("_k").orderBy("_b", "_r")
    new = F.coalesce((F.lag("_f").over(across) != F.col("_f")).cast("int"), F.lit(1))
    numbered = partial.withColumn("_new", new).withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.where("_f").groupBy(F.col("_k").alias(key), "_run")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")).drop("_run")
    )


def merge_gaps(intervals: DataFrame, key: str, max_gap: int, min_length: int = 0, strict: bool = True) -> DataFrame:
    """Drop intervals under ``min_length``, then join neighbours whose gap is under ``max_gap`` (at most, if not strict)."""
    kept = intervals.where(F.col("end_us") - F.col("start_us") >= min_length)
    w = Window.partitionBy(key).orderBy("start_us", "end_us")
    gap = F.col("start_us") - F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = gap < max_gap if strict else gap <= max_gap
    parts = kept.withColumn("_new", F.coalesce((~near).cast("int"), F.lit(1)))
    parts = parts.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(key, "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("parts")).drop("_g")


def night_overlap_hours(start: Column, end: Column, night_start: int = 22 * HOUR, night_end: int = 9 * HOUR) -> Column:
    """Hours of overlap with the nights: two candidate nights inside one day, the first day's night over two, else 0."""
    first, last = day_of(start) * DAY, day_of(end) * DAY

    def overlap(night_day: Column) -> Column:
        a, b = night_day + night_start, night_day + DAY + night_end
        return F.greatest(F.least(end, b) - F.greatest(start, a), F.lit(0)) / HOUR

    return (
        F.when(first == last, overlap(first - DAY) + overlap(first)).when(last == first + DAY, overlap(first)).otherwise(F.lit(0.0))
    )


def select_nights(intervals: DataFrame, key: str, min_overlap_h: float = 2.0, min_length_h: float = 4.0) -> DataFrame:
    """Intervals that overlap a night enough and last longer than ``min_length_h``, numbered from 0 for each key."""
    length = (F.col("end_us") - F.col("start_us")) / HOUR
    chosen = intervals.withColumn("night_h", night_overlap_hours(F.col("start_us"), F.col("end_us")))
    chosen = chosen.where((F.col("night_h") >= min_overlap_h) & (length > min_length_h))
    return chosen.withColumn("night", F.row_number().over(Window.partitionBy(key).orderBy("start_us")) - 1)


def in_intervals(df: DataFrame, intervals: DataFrame, key: str, ts: str, name: str, bucket: int = DAY) -> DataFrame:
    """``df`` with the boolean column ``name``: the row's time lies in an interval of its key, ends included.

    Intervals are spread over the buckets they touch and merged there, so the join is a hash or
    sort-merge join on (key, bucket) whose matches are few, whatever the tables' sizes.
    """
    own = merge_gaps(intervals.select(key, "start_us", "end_us"), key, 0, strict=False).select(
        F.col(key).alias("_ik"), "start_us", "end_us",
        F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor(F.col("end_us") / bucket))).alias("_ib"),
    )
    own = own.groupBy("_ik", "_ib").agg(F.collect_list(F.struct("start_us", "end_us")).alias("_spans"))
    t = col(ts)
    hit = F.exists("_spans", lambda s: (s["start_us"] <= t) & (t <= s["end_us"]))
    joined = df.withColumn("_b", F.floor(t / bucket)).join(own, (col(key) == F.col("_ik")) & (F.col("_b") == F.col("_ib")), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_b", "_ik", "_ib", "_spans")


def max_overlap(left: DataFrame, right: DataFrame, key: str, tolerance: int = 2 * MINUTE, share: float = 0.5, bucket: int = DAY) -> DataFrame:
    """For each left interval (key, start_us, end_us) the right one that overlaps it most; ``matched`` from ``share`` of its length.

    Right intervals are widened by ``tolerance`` at both ends; of equal overlaps the earlier wins.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    ls = left.select(key, F.col("start_us").alias("ls"), F.col("end_us").alias("le"), spread(F.col("start_us"), F.col("end_us")).alias("_b"))
    rs = right.select(
        key, (F.col("start_us") - tolerance).alias("rs"), (F.col("end_us") + tolerance).alias("re"),
        spread(F.col("start_us") - tolerance, F.col("end_us") + tolerance).alias("_b"),
    )
    overlap = F.least("le", "re") - F.greatest("ls", "rs")
    # A pair that shares several buckets is kept in the first.
    first = F.col("_b") == F.greatest(F.floor(F.col("ls") / bucket), F.floor(F.col("rs") / bucket))
    pairs = ls.join(rs, [key, "_b"]).where((overlap > 0) & first).withColumn("overlap_us", overlap)
    best = pairs.groupBy(key, "ls", "le").agg(F.max(F.struct("overlap_us", (-F.col("rs")).alias("m"), (-F.col("re")).alias("e"))).alias("best"))
    out = left.select(key, F.col("start_us").alias("ls"), F.col("end_us").alias("le")).distinct().join(best, [key, "ls", "le"], "left")
    got = F.coalesce(F.col("best.overlap_us"), F.lit(0))
    return out.select(
        key, F.col("ls").alias("start_us"), F.col("le").alias("end_us"), got.alias("overlap_us"),
        (-F.col("best.m") + tolerance).alias("match_start_us"), (-F.col("best.e") - tolerance).alias("match_end_us"),
        ((got >= share * (F.col("le") - F.col("ls"))) & (got > 0)).alias("matched"),
    )


def overnight(start: Column, end: Column) -> Column:
    """Ends on a later day, or at an earlier hour of the day than it starts."""
    return (day_of(end) > day_of(start)) | (hour_of(end) < hour_of(start))


def conflict_rules(runs_: DataFrame, windows: DataFrame, bounds: DataFrame, key: str, edge_h: float = 4.0, long_h: float = 4.0) -> DataFrame:
    """What to do with each non-wear run that lies inside a sleep window: the first rule that fits, as an action.

    ``runs_`` and ``windows`` are (key, start_us, end_us), ``bounds`` is (key, first_us, last_us) of the
    recordings.  Rules only clear sleep or set wear from unchanged inputs, so the order of runs is
    free: R1 clear up to the run's end, R2a clear the window, R2b clear from 8:00 of the last day,
    R3 worn, R4 and R6 clear the run, R5 clear the window; else it stays ambiguous.
    """
    w = windows.select(key, F.col("start_us").alias("ws"), F.col("end_us").alias("we"))
    inside = (F.col("ws") <= F.col("start_us")) & (F.col("end_us") <= F.col("we"))
    day = runs_.join(bounds, key)
    pairs = day.join(w, key).where(inside)
    pick = pairs.groupBy(key, "start_us", "end_us").agg(F.min(F.struct("ws", "we")).alias("w"))
    r = day.join(pick, [key, "start_us", "end_us"], "left")
    s, e = F.col("start_us"), F.col("end_us")
    length = (e - s) / HOUR
    in_night = lambda t: (hour_of(t) >= 22) | (hour_of(t) < 9)
    night = in_night(s) & in_night(e)
    over = overnight(F.col("w.ws"), F.col("w.we"))
    has = F.col("w").isNotNull()
    rule = (
        F.when(~has, "none")
        .when(s < F.col("first_us") + int(edge_h * HOUR), "R1")
        .when((e > F.col("last_us") - int(edge_h * HOUR)) & over & (length > long_h), "R2a")
        .when(e > F.col("last_us") - int(edge_h * HOUR), "R2b")
        .when(night & (length < long_h), "R3")
        .when(~night & ((hour_of(s) < 9) | (hour_of(e) > 22)), "R4")
        .when(~night & ((over & (length > long_h)) | ~over), "R5")
        .when(~night & over & (length < long_h), "R6")
        .otherwise("none")
    )
    r = r.withColumn("rule", rule)
    clear_from = (
        F.when(F.col("rule") == "R1", F.col("first_us")).when(F.col("rule").isin("R2a", "R5"), F.col("w.ws"))
        .when(F.col("rule") == "R2b", day_of(F.col("last_us")) * DAY + 8 * HOUR).when(F.col("rule").isin("R4", "R6"), s)
    )
    clear_to = (
        F.when(F.col("rule").isin("R1", "R4", "R6"), e).when(F.col("rule").isin("R2a", "R5"), F.col("w.we")).when(F.col("rule") == "R2b", F.col("last_us"))
    )
    return r.select(key, "start_us", "end_us", "rule", clear_from.alias("clear_from_us"), clear_to.alias("clear_to_us"), (F.col("rule") == "R3").alias("set_wear"))


def window_stats(windows: DataFrame, bouts: DataFrame, key: str) -> DataFrame:
    """Per sleep window: hours, slept hours (minutes rounded per bout), awakenings time (WASO) and efficiency."""
    b = bouts.select(key, F.col("start_us").alias("bs"), F.col("end_us").alias("be"))
    inside = (F.col("bs") >= F.col("start_us")) & (F.col("be") <= F.col("end_us"))
    pairs = windows.select(key, "start_us", "end_us").join(b, key).where(inside)
    slept = pairs.groupBy(key, "start_us", "end_us").agg(
        F.sum(F.round((F.col("be") - F.col("bs")) / MINUTE)).alias("sleep_min"), F.min("bs").alias("onset_us"), F.max("be").alias("wake_us"), F.count(F.lit(1)).alias("bouts")
    )
    minutes = (F.col("end_us") - F.col("start_us")) / MINUTE
    return slept.select(
        key, "start_us", "end_us", "bouts", (minutes / 60).alias("duration_h"), (F.col("sleep_min") / 60).alias("sleep_h"),
        (F.col("sleep_min") / minutes).alias("efficiency"), (((F.col("wake_us") - F.col("onset_us")) / MINUTE - F.col("sleep_min")) / 60).alias("waso_h"),
    )


def overlapping_days(us: Column) -> Column:
    """Number of the noon-to-noon day."""
    return F.floor((us - 12 * HOUR) / DAY)


__all__ = [
    "conflict_rules", "in_intervals", "max_overlap", "merge_gaps", "night_overlap_hours", "overlapping_days", "overnight",
    "runs", "select_nights", "sessionize", "time_of_day", "window_stats",
]
