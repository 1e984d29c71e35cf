"""Arrays of equally shaped structs, to be unfolded with ``inline`` (an unpivot without a shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def struct_rows(names: str, *rows: tuple) -> Column:
    """``names`` is a blank separated list; plain Python values become literals."""
    labels = names.split()

    def struct(row: tuple) -> Column:
        cells = [v if isinstance(v, Column) else F.lit(v) for v in row]
        return F.struct(*[c.alias(n) for c, n in zip(cells, labels, strict=True)])

    return F.array(*[struct(r) for r in rows])
