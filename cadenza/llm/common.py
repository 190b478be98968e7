"""Small helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.storage import materialised, shared_folder

__all__ = ["empty_text", "free_name", "materialised", "normalised_words", "read_table", "shared_folder", "slice_hashes"]

#: Bytes that separate words once text is UTF-8 encoded: ASCII other than letters and digits.
#: Capital ASCII letters fold to small ones, all other bytes stay.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def normalised_words(text: str | None) -> bytes:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text, A-Z folded, joined by one
    space, as UTF-8.  Empty for null and for texts without words."""
    if not text:
        return b""
    return b" ".join(text.encode("utf-8", "replace").translate(WORD_TABLE).split())


def empty_text(column: str):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd factor, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, base, np.uint64))))
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes."""
    p, back = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[:-1])))
        return mixed((total[ends] - total[starts]) * back[starts])
