"""Running values x -> a x + b over long ordered keys: maps are composed inside bounded chunks, then chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import stored

#: Rows of a chunk.
CHUNK = 4096


def composed(a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps from the start of each row's segment up to the row, by doubling: in each round a row takes in twice as many before it."""
    a, b, by = a.copy(), b.copy(), 1
    longest = int(np.bincount(np.unique(segment, return_inverse=True)[1]).max(initial=0))
    while by < longest:
        same = segment[by:] == segment[:-by]
        b[by:] = np.where(same, a[by:] * b[:-by] + b[by:], b[by:])
        a[by:] = np.where(same, a[by:] * a[:-by], a[by:])
        by *= 2
    return a, b


def prefix_maps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, a, b): of steps (keys, row from 0, a, b), x -> a x + b composed from the key's first row up to each row.

    Chunks of CHUNK rows are composed apart, many keys in one batch; the maps of whole chunks are steps of a series of their own, shorter by CHUNK. So no key is
    one task, and rounds are the logarithm of the longest key. A key's rows must be numbered without gaps.
    """
    columns = [*keys, "row", "a", "b"]
    schema = steps.select(*columns).schema

    def inside(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            new = (part["row"] % CHUNK == 0).to_numpy().cumsum()
            last = new == new[-1] if len(new) else np.zeros(0, bool)
            held, part, new = part[last], part[~last], new[~last]
            if len(part):
                a, b = composed(part["a"].to_numpy(float), part["b"].to_numpy(float), new)
                yield part.assign(a=a, b=b)
        if held is not None and len(held):
            a, b = composed(held["a"].to_numpy(float), held["b"].to_numpy(float), np.zeros(len(held), int))
            yield held.assign(a=a, b=b)

    chunk = F.floor(F.col("row") / CHUNK)
    parts = steps.select(*columns, chunk.alias("_chunk")).repartition(*keys, "_chunk").sortWithinPartitions(*keys, "row").select(*columns)
    maps = stored(parts.mapInPandas(inside, schema), "affine-maps")
    if not maps.where(F.col("row") >= CHUNK).take(1):
        return maps
    whole = maps.groupBy(*keys, chunk.alias("row")).agg(F.max_by(F.struct("a", "b"), "row").alias("m")).select(*keys, "row", "m.a", "m.b")
    before = prefix_maps(whole, keys).select(*keys, (F.col("row") + 1).alias("_chunk"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = maps.withColumn("_chunk", chunk).join(before, [*keys, "_chunk"], "left")
    return both.select(*keys, "row", (F.col("a") * F.coalesce("_a", F.lit(1.0))).alias("a"), (F.col("a") * F.coalesce("_b", F.lit(0.0)) + F.col("b")).alias("b"))
