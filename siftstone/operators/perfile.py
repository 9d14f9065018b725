"""Maps over files: one Arrow batch of files in, the rows of each file out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 20_000  #: rows of an outgoing batch


def per_file(files: DataFrame, keep: list[str], given: list[str], make, schema: str) -> DataFrame:
    """The columns `keep` of each row of files, with every row that make(*given) yields.

    Files travel in Arrow batches and nothing crosses rows, so a lost executor
    costs its tasks alone; a batch of results never outgrows ROWS rows.
    """
    made = _parse_datatype_string(schema)
    out = StructType([*(files.schema[c] for c in keep), *made.fields])
    arrow = to_arrow_schema(out)

    def go(batches):
        rows: list = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], arrow.names)
            rows.clear()
            return done

        for b in batches:
            kept = [b.column(i).to_pylist() for i in range(len(keep))]
            args = [b.column(i).to_pylist() for i in range(len(keep), b.num_columns)]
            for i in range(b.num_rows):
                head = tuple(c[i] for c in kept)
                for row in make(*(c[i] for c in args)):
                    rows.append((*head, *row))
                    if len(rows) >= ROWS:
                        yield batch()
        yield batch()

    # Positions, not names: a column may be kept and given.
    picked = files.select(*[files[c].alias(f"k{i}") for i, c in enumerate(keep)], *[files[c].alias(f"g{i}") for i, c in enumerate(given)])
    return picked.mapInArrow(go, out)
