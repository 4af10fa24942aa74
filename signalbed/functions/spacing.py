"""Keep the first of every run of times that lie closer than a gap.

A time is kept when it is at least ``gap`` after the last kept one. Which times
stay depends on all kept before, so no window function can tell. A key is cut
into chunks of consecutive times; a task walks one chunk. Where a key has more
than one chunk, each chunk first says where its walk would leave from every
place it may be entered at, and the chunks are then chained by doubling joins.
No task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.functions.ordered import neighbours, running_total
from signalbed.session import cut_lineage

CHUNK_ROWS = 200_000


def _walk(times: np.ndarray, gap: int, start: int) -> np.ndarray:
    kept, place = [], int(np.searchsorted(times, start))
    while place < len(times):
        kept.append(place)
        place = int(np.searchsorted(times, times[place] + gap))
    return times[kept]


def _last_kept(times: np.ndarray, gap: int) -> np.ndarray:
    """For a walk entered at each time, the last time it keeps."""
    places = np.arange(len(times))
    step = np.searchsorted(times, times + gap)
    step = np.where(step < len(times), step, places)
    while True:
        further = step[step]
        if np.array_equal(further, step):
            return times[step]
        step = further


def keep_spaced(times: DataFrame, key: str, at: str, gap: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, at) of the kept times. ``times`` has one row per (key, at); ``gap`` > 0 is fixed per key."""
    rows = times.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(gap).alias("gap"))
    rows = running_total(rows.withColumn("_one", F.lit(1)), ["key"], "at", "_one", "_rank")
    rows = cut_lineage(rows.select("key", "at", "gap", F.expr(f"(_rank - 1) div {chunk_rows}").alias("chunk")))
    last_chunk = rows.agg(F.max("chunk")).first()[0] or 0
    firsts = rows.groupBy("key").agg(F.min("at").alias("entry")).withColumn("chunk", F.lit(0).cast("long"))
    entries = _chunk_entries(rows, firsts, last_chunk)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _walk(np.sort(pdf["at"].to_numpy()), int(pdf["gap"].iloc[0]), int(pdf["entry"].iloc[0]))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "at": kept})

    schema = rows.select("key", "at").schema
    kept = rows.join(entries, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(walk, schema)
    return kept.select(F.col("key").alias(key), F.col("at").alias(at))


def _chunk_entries(rows: DataFrame, firsts: DataFrame, last_chunk: int) -> DataFrame:
    """(key, chunk, entry): the first kept time of every chunk that keeps any.

    The first chunk of a key is entered at its first time, so it has one way
    out; a key of one chunk needs none and takes no part.
    """
    rows = cut_lineage(rows.join(rows.where("chunk > 0").select("key").distinct(), "key", "left_semi"))

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        times, gap = np.sort(pdf["at"].to_numpy()), int(pdf["gap"].iloc[0])
        if pdf["chunk"].iloc[0] == 0:
            last = _walk(times, gap, int(times[0]))[-1:]
            return pd.DataFrame({"key": pdf["key"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry": times[:1], "asks": last + gap})
        # A walk comes in before the first time plus the gap, so at one of these.
        doors = int(np.searchsorted(times, times[0] + gap)) + 1
        left = _last_kept(times, gap)[:doors]
        return pd.DataFrame({
            "key": pdf["key"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry": times[:doors][: len(left)], "asks": left + gap,
        })

    key_type = rows.schema["key"].dataType.simpleString()
    doors = cut_lineage(
        rows.groupBy("key", "chunk").applyInPandas(leave, f"key {key_type}, chunk bigint, entry bigint, asks bigint")
    )
    asked = doors.select("key", F.col("asks").alias("at")).distinct()
    found = neighbours(rows.select("key", "at", "chunk"), asked, ["key"], "at", ["chunk"]).select(
        "key", F.col("at").alias("asks"), F.col("after.at").alias("next"), F.col("after.chunk").alias("next_chunk")
    )
    jumps = cut_lineage(doors.join(found, ["key", "asks"]).drop("asks"))

    # levels[j] leads from the entry of a block of 2^j chunks to the next block.
    levels = [jumps]
    span = 1
    while span <= last_chunk:
        span *= 2
        inside = F.expr(f"chunk div {span} = next_chunk div {span}")
        crossing = jumps.where("next IS NOT NULL").where(~inside)
        wanted = crossing.select("key", F.col("next").alias("entry")).unionByName(firsts.select("key", "entry")).distinct()
        onward = jumps.select(
            "key", F.col("entry").alias("next"), F.col("next").alias("_next"), F.col("next_chunk").alias("_next_chunk")
        )
        moved = jumps.join(wanted, ["key", "entry"], "left_semi").withColumn("_inside", F.coalesce(inside, F.lit(False)))
        jumps = cut_lineage(moved.join(onward, ["key", "next"], "left").select(
            "key", "chunk", "entry",
            F.when(F.col("_inside"), F.col("_next")).otherwise(F.col("next")).alias("next"),
            F.when(F.col("_inside"), F.col("_next_chunk")).otherwise(F.col("next_chunk")).alias("next_chunk"),
        ))
        levels.append(jumps)

    entries = firsts.select("key", "chunk", "entry")
    for level in reversed(levels[:-1]):
        inside = F.expr(f"chunk div {span} = next_chunk div {span}")
        reached = level.join(entries.select("key", "entry"), ["key", "entry"], "left_semi").where(inside)
        entries = cut_lineage(entries.unionByName(
            reached.select("key", F.col("next_chunk").alias("chunk"), F.col("next").alias("entry"))
        ))
        span //= 2
    return entries
