"""Exact nearest neighbours by pivots.

Rows go to the cell of their nearest pivot.  The cells' few smallest distances to their pivots bound a
query's distance to its k-th neighbour from above; the triangle inequality then rules out all cells
that lie farther off, and the query is sent to the others only.  Cells meet in blocks of bounded
size on both sides.  Equal vectors are one row with their few smallest ids, so that copies of one
point, or a feature without spread, don't meet each other pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import materialize

#: Pivots, candidates they are chosen from, rows of a block, and keys over which a hot group is spread.
PIVOTS, CANDIDATES, BLOCK, SALT = 64, 1024, 2048, 32


def first_per_group(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``: first of each salted part, then of the parts' firsts."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALT)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_i", F.row_number().over(part)).where(F.col("_i") <= k)
    return few.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= k).drop("_salt", "_i")


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different points, each the farthest from those before it."""
    if not len(points):
        return points
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two small sets of points."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), width)


def nearest(queries: DataFrame, data: DataFrame, id_col: str, features: list[str], k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(query, place, neighbour, distance): of each query the ``k`` nearest rows of ``data`` by Euclidean distance, equal ones by id.

    A row is no neighbour of its own id.  Rows with a null feature or id take no part; rows that
    repeat an id and vector count once; where fewer than ``k`` others exist, all are given.  Ids of
    both tables have one type.  Other columns are not read.
    """
    spark, width = data.sparkSession, len(features)
    vector = F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features]).alias("v")  # -0.0 becomes 0.0
    whole = lambda df: df.select(F.col(id_col).alias("id"), vector).where(F.col("id").isNotNull() & ~F.exists("v", F.isnull))
    # Of equal vectors the k + 1 smallest ids are enough: one of them may be the query's own.
    ids = first_per_group(whole(data).distinct(), ["v"], ["id"], k + 1)
    points = materialize(ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    asked = materialize(whole(queries).select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    sample = points.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(CANDIDATES).toPandas()  # at most CANDIDATES rows
    centres = spread_out(_matrix(sample["v"], width), pivots)
    kind = data.schema[id_col].dataType.simpleString()
    result = f"q long, id {kind}, distance double"
    if not len(centres):
        return spark.createDataFrame([], f"query {kind}, place int, neighbour {kind}, distance double")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf["v"], width), centres)
            yield pdf.assign(cell=d.argmin(1).astype(np.int32), away=d.min(1))

    placed = materialize(points.mapInPandas(assign, f"v array<double>, ids array<{kind}>, cell int, away double"), "placed")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).toPandas()  # a row a pivot
    least = first_per_group(placed.select("cell", "away", "v"), ["cell"], ["away", "v"], k + 1).select("cell", "away").toPandas()  # k + 1 rows a pivot
    held, near, far = cells["cell"].to_numpy(), cells["near"].to_numpy(), cells["far"].to_numpy()
    count = dict(zip(held.tolist(), cells["n"].tolist(), strict=True))
    bound_cell, bound_away = least["cell"].to_numpy(), least["away"].to_numpy()
    between = distances(centres, centres)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = distances(_matrix(pdf["v"], width), centres)
            upper = d[:, bound_cell] + bound_away
            upper = np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k else np.full(len(d), np.inf)
            upper = (upper * (1 + 1e-9) + 1e-300)[:, None]
            home = d.argmin(1)
            # No nearer than the plane between the own pivot and the cell's.
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - d[np.arange(len(d)), home, None] ** 2) / (2 * between[home])
            plane = np.where(np.isfinite(plane), plane, 0.0)[:, held]
            lower = np.maximum(np.maximum(d[:, held] - far, near - d[:, held]), plane * (1 - 1e-9))
            row, at = np.nonzero(lower <= upper)
            yield pd.DataFrame({"q": pdf["q"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "cell": held[at].astype(np.int32)})

    visits = materialize(asked.mapInPandas(visit, "q long, v array<double>, cell int"), "visits")
    calls = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    parts = spark.createDataFrame([(int(c), -(-count[c] // block), -(-calls.get(c, 0) // block)) for c in count], "cell int, data_parts int, query_parts int")
    # A row a pivot; each row of one side meets all blocks of the other.
    left = placed.join(parts, "cell").where("query_parts > 0").select(
        "cell", "v", "ids", F.pmod(F.xxhash64("v"), "data_parts").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("b")
    )
    right = visits.join(parts, "cell").select("cell", "q", "v", F.pmod(F.xxhash64("q"), "query_parts").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("data_parts") - 1)).alias("a"))

    def compare(data_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(data_rows) or not len(query_rows):
            return pd.DataFrame({"q": [], "id": [], "distance": []})
        points, places, out = _matrix(data_rows["v"], width), data_rows["ids"].tolist(), []
        for lo in range(0, len(query_rows), 256):
            some = query_rows.iloc[lo : lo + 256]
            d = distances(_matrix(some["v"], width), points)
            take = min(k + 1, d.shape[1])
            # All points up to the distance of the (k + 1)-th, so that ties are settled by id.
            edge = np.partition(d, take - 1, axis=1)[:, take - 1]
            for q, row, most in zip(some["q"].tolist(), d, edge, strict=True):
                best = sorted((row[j], i) for j in np.flatnonzero(row <= most) for i in places[j])
                out += [(q, i, dist) for dist, i in best[: k + 1]]
        return pd.DataFrame(out, columns=["q", "id", "distance"])

    met = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInPandas(compare, result)
    # At most k + 1 rows for each block that a query visits.
    best = met.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("i") <= k + 1)
    own = whole(queries).distinct().join(asked, "v").select(F.col("id").alias("query"), "q")
    pairs = own.join(best, "q").where("query <> id")
    place = F.row_number().over(Window.partitionBy("query", "q").orderBy("distance", "id")).alias("place")
    return pairs.select("query", place, F.col("id").alias("neighbour"), "distance").where(F.col("place") <= k)


def knn_predict(train: DataFrame, rows: DataFrame, id_col: str, label: str, features: list[str], k: int = 5, weights: str = "uniform") -> DataFrame:
    """(id, probability): the share of label 1 among the ``k`` nearest training rows, weighed evenly or by 1 / distance (``weights="distance"``).

    With distances, neighbours at distance 0 alone count where there are any.  An id that repeats in
    ``train`` counts by its largest label.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights}")
    # The ids of the two tables need not be about the same rows: neighbours with the row's own id count too.
    tag = lambda df, side: df.withColumn("_id", F.concat(F.lit(side), F.col(id_col).cast("string")))
    near = nearest(tag(rows, "q"), tag(train, "t"), "_id", features, k)
    labels = tag(train, "t").groupBy("_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    scored = near.join(labels, near.neighbour == labels._id)
    if weights == "distance":
        exact = F.min("distance").over(Window.partitionBy("query")) == 0
        scored = scored.withColumn("w", F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance")))
    else:
        scored = scored.withColumn("w", F.lit(1.0))
    voted = scored.groupBy("query").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("probability"))
    names = tag(rows, "q").select(F.col(id_col), "_id").distinct()
    return names.join(voted, names._id == voted.query).select(id_col, "probability")
