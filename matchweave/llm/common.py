"""What the operators share: Arrow batches of bounded size, appended columns, stored tables, rows numbered in groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.sources.tables import shared_dir

#: Text bytes that a worker handles at a time; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with at most ``limit`` bytes in ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def append(df: DataFrame, column: str, fields: list[T.StructField],
           compute: Callable[[pa.RecordBatch], list[pa.Array]], limit: int = BATCH_BYTES) -> DataFrame:
    """``df`` with the new ``fields`` that ``compute`` makes of each bounded batch.

    A column of ``df`` that has the name of a new field is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    out = [f.name for f in fields]

    def run(batches):
        for part in bounded(batches, column, limit):
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + compute(part), names=names + out)

    return df.mapInArrow(run, T.StructType(kept + fields))


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: lineage ends, lost executors don't matter.

    ``folders`` are columns each of whose values gets a folder of its own.
    """
    path = shared_dir(df.sparkSession, f"llm-{name}")
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``n``, the position in its group from 0, and ``total``, the rows of the group.

    Rows are dealt to sorted ranges, so a group with a third of all rows is many tasks; what is
    counted for each group and range says where a range begins.  ``df`` is stored before, as ranges are
    found by reading it once more.
    """
    ranged = stored(df, "unnumbered").repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("total"))
    return rows.join(runs, [group, "part"]).withColumn("n", F.col("at") + F.col("shift")).drop("at", "part", "shift")
