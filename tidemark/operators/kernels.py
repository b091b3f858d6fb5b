"""Array kernels spread over recordings: chunks with context, one group a chunk.

A recording is cut into chunks; each chunk's group also gets the rows of its neighbours that lie
within the context, so a long recording is many groups of bounded size and the result is that
of the whole signal to within the context's decay.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dsp
from tidemark.functions.columns import MINUTE, SECOND

CHUNK, CONTEXT = 10 * MINUTE, 30 * SECOND


def chunked(df: DataFrame, key: str, ts: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, chunk: int = CHUNK, before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """``f`` over each chunk's rows in time order, context included; rows of the context are dropped from the result.

    ``f`` must keep one row for each row, and ``schema`` its columns, ``ts`` among them.
    """
    own = F.floor(F.col(ts) / chunk)
    places = F.array_distinct(F.array(own, F.floor((F.col(ts) - after) / chunk), F.floor((F.col(ts) + before) / chunk)))
    spread = df.withColumn("_chunk", F.explode(places))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable", ignore_index=True)
        mine = (pdf[ts] // chunk == pdf["_chunk"]).to_numpy()
        return f(pdf)[mine][schema.names] if mine.any() else pdf.iloc[:0].reindex(columns=schema.names)

    return spread.groupBy(key, "_chunk").applyInPandas(run, schema)


def butterworth_filter(df: DataFrame, key: str, ts: str, axes: list[str], fs: float | str, low: float | None = None, high: float | None = None, order: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase filtered axes; other columns unchanged.  ``fs`` is the rate of all recordings, or the column that has each one's."""
    fixed = None if isinstance(fs, str) else dsp.butterworth(order, low, high, fs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sections = dsp.butterworth(order, low, high, float(pdf[fs].iloc[0])) if fixed is None else fixed
        pdf[axes] = dsp.zero_phase(pdf[axes].to_numpy(float), sections)
        return pdf

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in axes else f.dataType) for f in df.schema])
    return chunked(df, key, ts, run, schema, chunk)


def forward_medians(df: DataFrame, key: str, ts: str, axes: list[str], width: int | None, fs: float | str, chunk: int = CHUNK, seconds: int = 5) -> DataFrame:
    """Medians of each row and the ``width - 1`` after it at the raw rate; null where the recording ends before.

    Where ``fs`` is a column of rates, the width is that of ``seconds``.
    """
    own = isinstance(fs, str)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = max(1, int(float(pdf[fs].iloc[0]) * seconds)) if own else width
        for a in axes:
            pdf[a] = pdf[a].iloc[::-1].rolling(rows).median().iloc[::-1]
        return pdf

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in axes else f.dataType) for f in df.schema])
    # A recording's own width spans its seconds and one sample, whatever the rate from a tenth of a hertz on.
    after = (seconds + 11) * SECOND if own else int((width + 1) * SECOND / fs) + SECOND
    return chunked(df, key, ts, run, schema, chunk, before=0, after=after)


def spectral_schema(key: str, kind: str) -> str:
    names = [*(f"asd_{t}" for t in (1, 2, 4, 8, 16)), *(f"{c}{i}" for i in (1, 2, 3) for c in "fp"), "sp_entropy", "avg_sp_power"]
    names += ["zeros", "ac_first_max", "loc_first_max", "ac_first_min", "loc_first_min"]
    names += ["peaks_per_sec", "avg_peak_prom", "max_peak_prom", "min_peak_prom", "sampen", "hurst_rs"]
    return f"{key} {kind}, " + ", ".join(f"{n} double" for n in names)


def bout_features(df: DataFrame, key: str, array: str, fs: float) -> DataFrame:
    """Spectral, autocorrelation, peak, entropy and scaling features of each row's sample array, in Arrow batches."""
    schema = spectral_schema(key, df.schema[key].dataType.simpleString())

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf[key], pdf[array], strict=True):
                v = np.asarray(v if v is not None else [], float)
                rows.append({key: k, **dsp.spectral_features(v, fs), **dsp.autocorrelation_features(v, fs), **dsp.peak_features(v, fs), "sampen": dsp.sample_entropy(v), "hurst_rs": dsp.hurst(v)})
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({n: float for n in names[1:]})

    return df.select(key, array).mapInPandas(run, schema)
