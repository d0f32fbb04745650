"""A filter of fixed size that spares rows without a partner a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MB). It is sent to all tasks, so its size does not follow
#: the data; one that is too full only lets more rows pass to the join behind it.
FILTER_BITS = 1 << 23


def slots(values: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return values.astype(np.int64) & (bits - 1)


def send_filter(values: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """Marks the slots of the first column (long, no nulls) and sends them to all tasks."""

    slot = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1))
    # At most `bits` distinct slots; one row of 8 KB for each 65,536 of them.
    marked = values.select(slot.alias("slot")).distinct().withColumn("part", F.shiftright("slot", 16))

    def pack(key, group):
        seen = np.zeros(1 << 16, bool)
        seen[group["slot"].to_numpy() & 0xFFFF] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "b": [np.packbits(seen).tobytes()]})

    out = np.zeros((bits >> 16, 1 << 13), np.uint8)
    # At most `bits >> 16` rows, 1 MB in all, in one job.
    for row in marked.groupBy("part").applyInArrow(pack, "part long, b binary").collect():
        out[row.part] = np.frombuffer(row.b, np.uint8)
    return values.sparkSession.sparkContext.broadcast(out.tobytes())


def passes(sent: Broadcast, values: np.ndarray) -> np.ndarray:
    """Which values may be among the marked ones."""
    marked = np.frombuffer(sent.value, np.uint8)
    at = slots(values, 8 * len(marked))
    return (marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
