"""Compatibility decomposition, which Spark has no function for (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StringType

from .batches import each


def decomposed(x: str | None) -> str:
    return unicodedata.normalize("NFKD", x or "").replace("\u00a0", " ").strip()


def folded(x: str | None) -> str:
    return unicodedata.normalize("NFKD", x or "").replace("–", "-").replace("—", "-").replace("\u00a0", " ").encode("ascii", "ignore").decode("ascii")


@arrow_udf(StringType())
def nfkd(s: pa.Array) -> pa.Array:
    """NFKD, no-break space as space, trimmed; null gives ''."""
    return each(s, decomposed, pa.string())


@arrow_udf(LongType())
def nfkd_size(s: pa.Array) -> pa.Array:
    """Length of ``nfkd`` in code points; the text itself stays in its batch."""
    return each(s, lambda x: len(decomposed(x)), pa.int64())


@arrow_udf(StringType())
def ascii_fold(s: pa.Array) -> pa.Array:
    """NFKD, dashes as '-', and only ASCII kept; null gives ''."""
    return each(s, folded, pa.string())
