"""Vectors: exact cosine in built-in functions, quantised decisions, the stored big-endian form."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENCODED = T.StructType().add("bytes", T.BinaryType()).add("hash", T.StringType()).add("norm", T.DoubleType()).add("error", T.StringType())
_DECODED = T.StructType().add("vector", T.ArrayType(T.FloatType())).add("error", T.StringType())


def dot(a: Column, b: Column) -> Column:
    """Products added up in the order of the dimensions, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    c = dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def quantised(c: Column, half_even: bool = False) -> Column:
    """Six decimals, halves away from zero (or to even)."""
    return (F.bround(c, 6) if half_even else F.round(c, 6)).cast("decimal(7,6)")


def seconds_apart(a: Column, b: Column) -> Column:
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1_000_000).cast("long")


def _by_length(values: pd.Series) -> list[tuple[int, np.ndarray]]:
    """(length, places) of the values that aren't null, so that all of one length are worked on at once."""
    lengths = np.array([-1 if v is None else len(v) for v in values])
    return [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths) if n >= 0]


@F.pandas_udf(_ENCODED)
def encoded(vectors: pd.Series, dimension: pd.Series) -> pd.DataFrame:
    """Unit vector as big-endian float32, its SHA-256 and the norm before; or DIMENSION_MISMATCH, NON_FINITE_VECTOR, ZERO_NORM."""
    out = pd.DataFrame({"bytes": None, "hash": None, "norm": np.nan, "error": "DIMENSION_MISMATCH"}, index=range(len(vectors))).astype(object)
    for n, at in _by_length(vectors):
        at = at[dimension.to_numpy()[at] == n]
        if not len(at):
            continue
        x = np.array([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at]).reshape(len(at), n)
        norms = np.sqrt((x * x).sum(1))
        finite = np.isfinite(x).all(1)
        good = finite & (norms > 0)
        data = (x[good] / norms[good, None]).astype(">f4")
        out.loc[at[~finite], "error"], out.loc[at[finite & ~good], "error"], out.loc[at[good], "error"] = "NON_FINITE_VECTOR", "ZERO_NORM", None
        for i, row, norm_ in zip(at[good], data, norms[good]):
            b = row.tobytes()
            out.at[i, "bytes"], out.at[i, "hash"], out.at[i, "norm"] = b, hashlib.sha256(b).hexdigest(), norm_
    out["norm"] = out["norm"].astype(float)
    return out


@F.pandas_udf(_DECODED)
def decoded(data: pd.Series, dimension: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Vector of stored bytes; or VECTOR_BYTE_LENGTH, VECTOR_HASH, NON_FINITE_VECTOR, ZERO_NORM."""
    out = pd.DataFrame({"vector": None, "error": "VECTOR_BYTE_LENGTH"}, index=range(len(data))).astype(object)
    for n, at in _by_length(data):
        at = at[4 * dimension.to_numpy()[at] == n]
        if not len(at):
            continue
        x = np.frombuffer(b"".join(data.iloc[i] for i in at), ">f4").reshape(len(at), -1).astype(np.float32)
        finite, some = np.isfinite(x).all(1), x.any(1)
        same = np.array([hashlib.sha256(data.iloc[i]).hexdigest() == expected.iloc[i] for i in at])
        for rule, code in ((~some, "ZERO_NORM"), (~finite, "NON_FINITE_VECTOR"), (~same, "VECTOR_HASH")):
            out.loc[at[rule], "error"] = code
        good = same & finite & some
        out.loc[at[good], "error"] = None
        for i, row in zip(at[good], x[good]):
            out.at[i, "vector"] = row
    return out
