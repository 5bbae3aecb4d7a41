"""Identities of chosen bundles, made by SQL functions.

A bundle of zeros and ones is written as one character an item; any other as ``v:`` and its values, each in the shortest
form that reads back as the same double (a negative zero counts as zero).  Different bundles of one length have different keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "v:"


def sql_key(bundle: Column) -> Column:
    """Key of an array column."""
    values = F.transform(bundle, lambda b: b.cast("double") + F.lit(0.0))
    plain = F.forall(values, lambda v: (v == 0) | (v == 1))
    short = F.array_join(F.transform(values, lambda v: F.when(v == 0, "0").otherwise("1")), "")
    return F.encode(F.when(plain, short).otherwise(F.concat(F.lit(OTHER), F.array_join(F.transform(values, lambda v: v.cast("string")), ","))), "UTF-8")


def values(key: bytes) -> np.ndarray:
    """The bundle of a key. Keys of aggregate cuts hold none: ValueError."""
    try:
        text = bytes(key).decode("ascii")
    except UnicodeDecodeError:
        raise ValueError("an aggregate cut has no bundle") from None
    if text.startswith(OTHER):
        return np.array([float(x) for x in text[len(OTHER) :].split(",")])
    if set(text) - {"0", "1"}:
        raise ValueError("an aggregate cut has no bundle")
    return np.array([float(c) for c in text])


def aggregate_key(phi, epsilon: float) -> bytes:
    """Key of an aggregate cut: SHA-256 of its coefficients."""
    return hashlib.sha256(np.append(np.asarray(phi, float), float(epsilon)).tobytes()).digest()
