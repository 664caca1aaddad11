"""Text functions in Python over Arrow batches, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Rows, and characters of text, that are Python objects at one time.
_ROWS, _CHARS = 512, 1 << 20


def each(texts: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    """``function`` of every text (null: None).

    A batch holds up to 10,000 texts; as Python strings they and their results would take several times its bytes.
    """
    done: list[pa.Array] = []
    values: list = []
    chars = 0
    for text in texts:
        value = text.as_py()
        chars += len(value or "")
        values.append(function(value))
        if len(values) >= _ROWS or chars >= _CHARS:
            done.append(pa.array(values, kind))
            values, chars = [], 0
    return pa.concat_arrays([*done, pa.array(values, kind)])
