"""What the vector operators share: clean fixed-point rows of one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_point(vector: Column, scale: int, offset: int, bits: int) -> Column:
    """floor(scale * entry) + offset for each entry as a long, all floors down.

    Null unless the vector and all its entries are neither null nor non-finite.
    Entries of ``scale * entry`` beyond ``2 ** bits`` count as that.
    """
    limit = float(1 << bits)

    def whole(entry: Column) -> Column:
        return F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), entry.cast("double") * float(scale)))) + F.lit(offset)

    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, whole))


def common_length(rows: DataFrame, x: str) -> int:
    """The length that most arrays of column ``x`` have; of equally common ones the longest. 0 without rows."""
    counts = rows.groupBy(F.size(x).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return top[0]["length"] if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column, all of length ``width``, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
