"""Sequential rules over the ordered rows of each key, with a state of a few numbers.

Rows are sorted within partitions and stream through a fold in Arrow batches; no key is gathered, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.workers import by_value

by_value(__name__)

_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def fold(rows: DataFrame, key: list[str], order: list[str], values: list[str], begin: Callable, out: str) -> DataFrame:
    """The key, the order and what a rule says of each row.

    ``begin`` makes the rule of a key: a function of the row's order and values that returns the columns
    of ``out``. Rows that tie in ``order`` may come in any order.
    """
    kept = [*key, *order]
    names = [*kept, *(c.split()[0] for c in out.split(", "))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", " + out
    width = len(key)
    types = [_TYPES[c.split()[1]] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rule = None, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_pylist() for c in b.columns]
            said = []
            for row in zip(*columns):
                if row[:width] != last:
                    last, rule = row[:width], begin()
                said.append(rule(*row[width:]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(c, t) for c, t in zip(zip(*said), types))], names=names)

    spread = rows.select(*kept, *values).repartition(*key).sortWithinPartitions(*kept)
    return spread.mapInArrow(run, schema)
