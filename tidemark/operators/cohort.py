"""Cohort tables: cleaning, keys, label mapping, reconciliation, folds, weights, rebalancing, oversampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import col
from tidemark.functions.shared import materialize

from .neighbours import nearest

# Cells that mark a metadata row as a summary or a note.
SUMMARY_WORDS = ("total", "subtotal", "sum", "gesamt", "summe", "note", "notes", "mean", "average")
# Strings that stand for a missing record id.
MISSING = ("", "none", "nan", "null")


def exclude_flag(c: str | Column) -> Column:
    """Exclusion cells in canonical form: '1' for affirmative values, '?' as it is, else '0'."""
    v = F.lower(F.trim(col(c).cast("string")))
    return F.when(v.isin("1", "1.0", "true", "yes"), "1").when(v == "?", "?").otherwise("0")


def record_key(subject: str | Column, record: str | Column) -> Column:
    """The subject's id, with the record's in lower case where there is one."""
    clean = F.lower(F.trim(col(record).cast("string")))
    return F.concat_ws("_", F.trim(col(subject).cast("string")), F.when(~clean.isin(*MISSING), clean))


def finite(columns: Iterable[str]) -> Column:
    """Whether all the columns are numbers: not null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def problem_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, bad_rows, <column>_bad): how many cells and rows aren't finite."""
    bad = lambda c: F.sum((~finite([c])).cast("long")).alias(f"{c}_bad")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum((~finite(columns)).cast("long")).alias("bad_rows"), *[bad(c) for c in columns])


def replace_problems(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(finite([c]), F.col(c)).otherwise(F.lit(value)) for c in columns})


def drop_summary_rows(df: DataFrame, text_columns: list[str], numeric: list[str], words: tuple[str, ...] = SUMMARY_WORDS, share: float = 0.8) -> DataFrame:
    """Rows without a summary word, with two cells or more, and whose numbers are not the columns' sums or counts."""
    token = r"(?i)(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)|Σ"
    totals = df.agg(*[F.sum(c).alias(f"_s_{c}") for c in numeric], F.count(F.lit(1)).alias("_n"))
    joined = df.crossJoin(F.broadcast(totals))  # one row
    hit = F.lit(False)
    for c in text_columns:
        hit = hit | F.coalesce(F.col(c).rlike(token), F.lit(False))
    same = F.lit(0)
    for c in numeric:
        rest = F.col(f"_s_{c}") - F.col(c)
        same = same + F.coalesce(((F.abs(F.col(c) - rest) < 1e-9) | (F.col(c) == F.col("_n") - 1)).cast("int"), F.lit(0))
    filled = F.lit(0)
    for c in [*text_columns, *numeric]:
        filled = filled + F.coalesce((F.trim(F.col(c).cast("string")) != "").cast("int"), F.lit(0))
    total = (same >= share * len(numeric)) if numeric else F.lit(False)
    return joined.where(~hit & ~total & (filled >= 2)).select(*df.columns)


def fill_record_ids(df: DataFrame, subject: str, record: str, order: str) -> DataFrame:
    """Record ids for subjects with several records: rec1, rec2, ... in order where an id is missing, skipping those in use."""
    clean = F.trim(F.col(record).cast("string"))
    missing = clean.isNull() | F.lower(clean).isin(*MISSING)
    rows = df.withColumn("_missing", missing)
    stats = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"), F.collect_set(F.when(~F.col("_missing"), F.lower(clean))).alias("_used"))
    w = Window.partitionBy(subject, "_missing").orderBy(order)
    numbered = rows.withColumn("_i", F.row_number().over(w)).join(stats, subject)
    free = F.filter(F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda i: F.concat(F.lit("rec"), i)), lambda s: ~F.array_contains(F.col("_used"), s))
    new = F.when((F.col("_n") > 1) & F.col("_missing"), F.element_at(free, F.col("_i"))).otherwise(F.col(record))
    return numbered.withColumn(record, new).select(*df.columns)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts: an empty result is a valid table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def map_labels(df: DataFrame, code: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``label``, codes without one): ``mapping`` (code, label) is joined on the trimmed lower-case code."""
    m = mapping.select(F.lower(F.trim("code")).alias("_code"), "label").distinct()
    rows = df.withColumn("_code", F.lower(F.trim(F.col(code).cast("string")))).join(m, "_code", "left")
    return rows.where("label is not null").drop("_code"), rows.where("label is null").groupBy(code).agg(F.count(F.lit(1)).alias("n"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, status): 'missing' where only expected, 'extra' where only actual, 'both' else; a row for each key."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(True)), actual.select(key).distinct().withColumn("_a", F.lit(True))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("both")
    return e.join(a, key, "full").select(key, status.alias("status"))


def min_nights(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of groups with ``k`` rows or more."""
    enough = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(key)
    return df.join(enough, key, "left_semi")


def dataset_weights(df: DataFrame, dataset: str, label: str | None = None) -> DataFrame:
    """(dataset[, label], n, weight): every data set (and class in it) weighs the same in total; weights sum to the number of rows."""
    keys = [dataset, *([label] if label else [])]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_g"))
    return g.crossJoin(F.broadcast(t)).select(*keys, "n", (F.col("_t") / (F.col("_g") * F.col("n"))).alias("weight"))  # one row


def class_weights(df: DataFrame, label: str) -> DataFrame:
    return dataset_weights(df, label)


def rebalance(df: DataFrame, dataset: str, id_col: str, strategy: str, label: str | None = None, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Each data set cut to the strategy's number of rows: min, median, cap_absolute or cap_to_second_largest; rows are chosen by a hash of their id.

    With ``label`` the classes keep their shares, rounded down but never to none.
    """
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))
    if strategy == "min":
        target = sizes.agg(F.min("n").alias("_t"))
    elif strategy == "median":
        target = sizes.agg(F.floor(F.percentile("n", F.lit(0.5))).alias("_t"))
    elif strategy == "cap_absolute":
        target = sizes.agg(F.lit(cap).cast("long").alias("_t"))
    elif strategy == "cap_to_second_largest":
        target = sizes.agg(F.sort_array(F.collect_list("n"), asc=False).alias("a")).select(F.coalesce(F.try_element_at("a", F.lit(2)), F.col("a")[0]).alias("_t"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    keys = [dataset, *([label] if label else [])]
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    quota = cells.join(sizes, dataset).crossJoin(F.broadcast(target))  # one row
    share = F.least(F.lit(1.0), F.col("_t") / F.col("n"))
    quota = quota.select(*keys, F.greatest(F.floor(F.col("_c") * share), F.lit(1)).alias("_q"))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
    return df.withColumn("_i", F.row_number().over(w)).join(quota, keys).where("_i <= _q").select(*df.columns)


def leave_one_out_folds(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """(key, fold, role): each data set is the test set of its own fold and trains in the others."""
    folds = df.select(F.col(dataset).alias("fold")).distinct()
    # Data sets are few; each subject gets a row for each.
    pairs = df.select(key, dataset).distinct().join(F.broadcast(folds), how="cross")
    return pairs.select(key, "fold", F.when(F.col(dataset) == F.col("fold"), "test").otherwise("train").alias("role"))


def group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """(group, fold): stratified by the group's majority label, larger groups first dealt in turn; no group is split."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("stratum"))
    w = Window.partitionBy("stratum").orderBy(F.desc("n"), F.xxhash64(F.lit(seed), F.col(group)), group)
    place = F.row_number().over(w) - 1
    # There and back, so that the first fold doesn't get the largest group of each round.
    turn = F.pmod(place, F.lit(2 * k))
    return g.select(group, "n", "stratum", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))


def check_folds(folds: DataFrame) -> DataFrame:
    """(problem, n) of a fold table (subject_id, repeat, outer_fold, inner_fold, role); no rows for a valid one.

    Checked: known roles, a subject in one role a split, the test set the same over inner folds,
    each subject tested once a repeat, and a complete grid of splits.
    """
    c = ["repeat", "outer_fold", "inner_fold"]
    bad_role = folds.where(~F.col("role").isin("train", "validation", "test")).select(F.lit("role").alias("problem"))
    # Dealt by subject into a given number of parts: each row is a group of its own or nearly so, and a file's split
    # holds too many of them to aggregate before the shuffle.
    n = int(folds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = folds.select("subject_id", *c, "role").repartition(n, "subject_id")
    unlike = lambda v: F.min(v) < F.max(v)
    overlap = own.groupBy("subject_id", *c).agg(unlike("role").alias("k")).where("k").select(F.lit("overlap"))
    splits = folds.select(*c).distinct()
    inner = splits.groupBy("repeat", "outer_fold").agg(F.count(F.lit(1)).alias("inner"))
    tests = own.where("role = 'test'").groupBy("subject_id", "repeat", "outer_fold").agg(F.countDistinct("inner_fold").alias("k"))
    moved = tests.join(F.broadcast(inner), ["repeat", "outer_fold"]).where("k <> inner").select(F.lit("test_moves"))  # folds are few
    tested = F.when(F.col("role") == "test", F.col("outer_fold"))
    once = own.groupBy("subject_id", "repeat").agg(F.coalesce(unlike(tested), F.lit(True)).alias("k")).where("k").select(F.lit("not_tested_once"))
    grid = splits.agg((F.countDistinct("repeat") * F.countDistinct("outer_fold") * F.countDistinct("inner_fold") - F.countDistinct(*c)).alias("k")).where("k > 0").select(F.lit("grid"))
    return bad_role.union(overlap).union(moved).union(once).union(grid).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def smote(df: DataFrame, id_col: str, label: str, features: list[str], k: int = 5, seed: int = 42, group: str | None = None) -> DataFrame:
    """Synthetic minority rows (id of the base row, neighbour, features[, group]) until both classes are equal.

    Each lies between its base row and one of that row's ``k`` nearest minority rows (exact ones, see
    :mod:`.neighbours`), at a place drawn by hash.  Exactly as many rows are made as the classes
    differ by: each minority row gives as many, and some one more, chosen by hash; a row without
    neighbours is repeated, and one with fewer than ``k`` uses those.  With ``group`` a synthetic
    row carries the group of the minority row that is nearest to it.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    more_columns = [group] if group else []
    if len(counts) < 2:
        return df.where("false").select(F.col(id_col).alias("base"), F.col(id_col).alias("neighbour"), *features, *more_columns)
    minor = min(counts, key=lambda c: (counts[c], str(c)))
    lack = max(counts.values()) - counts[minor]
    minority = df.where(F.col(label) == minor)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = minority.select(F.col(id_col).alias("base"), vector.alias("v"))
    near = nearest(minority, minority, id_col, features, k, seed=seed)
    listed = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour"))).alias("near"))  # k at most
    more = rows.select("base").orderBy(F.xxhash64(F.lit(seed), "base"), "base").limit(lack % max(counts[minor], 1)).withColumn("one", F.lit(1))
    turns = rows.join(listed, F.col("base") == F.col("query"), "left").join(more, "base", "left").select(
        "base", "v", "near", (F.lit(lack // max(counts[minor], 1)) + F.coalesce("one", F.lit(0))).alias("turns")
    )
    drawn = turns.where("turns > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("turns"))))
    pick = F.element_at("near", (F.pmod(F.xxhash64(F.lit(seed), "base", "copy"), F.size("near")) + 1).cast("int"))
    drawn = drawn.select("base", "copy", "v", F.when(F.size("near") > 0, pick["neighbour"]).otherwise(F.col("base")).alias("neighbour"))
    other = rows.select(F.col("base").alias("neighbour"), F.col("v").alias("w"))
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), "base", "copy"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    made = drawn.join(other, "neighbour").select("base", "copy", "neighbour", *[(F.col("v")[i] + gap * (F.col("w")[i] - F.col("v")[i])).alias(f) for i, f in enumerate(features)])
    if not group:
        return made.select("base", "neighbour", *features)
    # Written, as its ids are asked for twice.
    named = materialize(made.withColumn("_new", F.concat(F.lit("n"), F.col("base").cast("string"), F.lit("-"), F.col("copy").cast("string"))), "smote")
    old = minority.withColumn("_new", F.concat(F.lit("o"), F.col(id_col).cast("string")))
    closest = nearest(named, old, "_new", features, 1, seed=seed).select(F.col("query").alias("_new"), "neighbour")
    groups = old.select(F.col("_new").alias("_near"), group).dropDuplicates(["_near"])
    owned = closest.join(groups, F.col("neighbour") == F.col("_near")).select("_new", group)
    return named.join(owned, "_new").select("base", "neighbour", *features, group)


def label_summary(df: DataFrame, dataset: str, label: str, subject: str) -> DataFrame:
    """Rows and subjects by data set and label, with all subtotals; null marks a total."""
    return df.rollup(dataset, label).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(subject).alias("subjects"))


def diary_rows(df: DataFrame, keys: list[str], columns: dict[str, str], day: str) -> DataFrame:
    """(keys, event, us): wide times of day (``columns``: event -> column of microseconds since midnight) as a row for each one given.

    Times of 0 to 5 o'clock of going to sleep belong to the day after.
    """
    pairs = F.array(*[F.struct(F.lit(e).alias("event"), F.col(c).cast("long").alias("tod")) for e, c in columns.items()])
    long = df.select(*keys, F.col(day).alias("_day"), F.explode(pairs).alias("x")).where("x.tod is not null")
    late = F.col("x.event").startswith("sleep") & (F.col("x.tod") < 6 * 3600 * 1_000_000)
    return long.select(*keys, F.col("x.event").alias("event"), (F.col("_day") + F.col("x.tod") + F.when(late, F.lit(86_400_000_000)).otherwise(F.lit(0))).alias("us"))
