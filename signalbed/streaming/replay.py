"""Rules on streams that depend on the order of events, with the results of the batch operators.

Rows may come in any order as long as they are not later than the watermark
allows. Each key keeps its rows until the watermark has passed them and then
replays them in event time, so what it answers does not depend on how the rows
were cut into batches: it is what the batch operator says of the same rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalbed.functions.times import MINUTE, SECOND, instant, micros
from signalbed.operators.traps import _active, _counting
from signalbed.session import shared_folder

#: The state of a key: what the rule remembers, and the rows the watermark has not passed, in blocks: their moments
#: (64-bit numbers, one block behind the other), how many each block has, and their items.
STATE = "memory string, at binary, sizes array<int>, items array<binary>"
#: Most rows of a block: few enough to unpack one for a single item.
BLOCK_ROWS = 1000
_MOMENT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

#: (key, memory, moment, items) -> (memory, outputs); outputs are texts, the items are fetched by a call.
Step = Callable[[tuple, object, int, Callable[[], list[str]]], tuple[object, list[str]]]
#: (key, memory, watermark in microseconds) -> (memory, outputs, moment to ask again or None); no memory: forget the key.
Idle = Callable[[tuple, object, int], tuple[object, list[str], int | None]]


#: Moments in order and their items, compressed: what waits is mostly text that is alike.
Block = tuple[np.ndarray, bytes]


def _packed(at: np.ndarray, items: Sequence[str]) -> list[Block]:
    order = np.argsort(at, kind="stable")
    parts = (order[n:n + BLOCK_ROWS] for n in range(0, len(order), BLOCK_ROWS))
    return [(at[part], zlib.compress(json.dumps([items[i] for i in part]).encode(), 1)) for part in parts]


def _unpacked(block: Block) -> list[str]:
    return json.loads(zlib.decompress(block[1]))


def _filled_up(blocks: Iterable[Block]) -> list[Block]:
    """The same rows with small blocks put together."""
    out: list[Block] = []
    for block in blocks:
        if out and len(out[-1][0]) + len(block[0]) <= BLOCK_ROWS:
            last = out.pop()
            block, = _packed(np.concatenate([last[0], block[0]]), _unpacked(last) + _unpacked(block))
        out.append(block)
    return out


def replay(rows: DataFrame, keys: Sequence[str], step: Step, idle: Idle, open_blocks: int | None = None) -> DataFrame:
    """(keys, out) of ``rows`` (keys, ``timestamp`` with a watermark, ``item``) in the order of time inside a key.

    ``step`` is told of a moment once the watermark is past it and may fetch all
    its items, ``idle`` is asked after the steps and when the moment comes that
    it named. Items wait in compressed blocks; a rule that fetches few of them
    needs no more than some ``open_blocks`` at a time. Rows without a time never
    come up.
    """
    rows = rows.where("timestamp IS NOT NULL").select(*keys, "timestamp", micros(F.col("timestamp")).alias("at"), "item")
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key = tuple(value.item() if hasattr(value, "item") else value for value in key)  # plain values instead of numpy's
        memory, blocks = None, []
        if state.exists:
            remembered, at, sizes, items = state.get
            memory = json.loads(remembered)
            cuts = np.cumsum(np.array(sizes, np.int64))[:-1]
            blocks = list(zip(np.split(np.frombuffer(bytes(at), np.int64), cuts), map(bytes, items))) if len(sizes) else []
        if not state.hasTimedOut:
            for pdf in batches:
                blocks += _packed(pdf["at"].to_numpy(np.int64), pdf["item"].tolist())
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        out: list[str] = []
        at = np.concatenate([np.zeros(0, np.int64), *(block[0] for block in blocks)])
        begins = np.cumsum([0, *(len(block[0]) for block in blocks)])
        due = at // 1000 * 1000 + 1000 < passed
        places = np.flatnonzero(due)
        places = places[np.argsort(at[places], kind="stable")]
        moments, firsts = np.unique(at[places], return_index=True)
        opened = lru_cache(open_blocks)(lambda n: _unpacked(blocks[n]))

        def fetched(places: np.ndarray) -> list[str]:
            of = np.searchsorted(begins, places, side="right") - 1
            return sorted(opened(int(n))[place - begins[n]] for place, n in zip(places, of))

        lasts = np.append(firsts[1:], len(places))
        for moment, first, last in zip(moments, firsts, lasts):
            memory, made = step(key, memory, int(moment), partial(fetched, places[first:last]))
            out += made
        left = []
        for n, block in enumerate(blocks):
            stays = ~due[begins[n]:begins[n + 1]]
            if stays.all():
                left.append(block)
            elif stays.any():
                left += _packed(block[0][stays], [item for item, stay in zip(_unpacked(block), stays) if stay])
        opened.cache_clear()
        memory, made, again = idle(key, memory, passed)
        out += made
        if left or memory is not None:
            left = _filled_up(left)
            state.update((json.dumps(memory), b"".join(b[0].tobytes() for b in left), [len(b[0]) for b in left], [b[1] for b in left]))
            # A timer goes off once the watermark is past it, so never before the moment.
            waits = [moment // 1000 + 1 for moment in ([min(int(b[0][0]) for b in left)] if left else []) + ([again] if again is not None else [])]
            if waits:
                state.setTimeoutTimestamp(max(min(waits), passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({**{name: [value] * len(out) for name, value in zip(keys, key)}, "out": out})

    return rows.groupBy(*keys).applyInPandasWithState(
        run, f"{key_schema}, out string", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame) -> DataFrame:
    """What a stream says of all its input there is now, written to the shared folder: a stream as a table."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4()}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(
        availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def frequency_stream(entries: DataFrame, traps: DataFrame | Iterable[Mapping], late: str = "10 minutes") -> DataFrame:
    """(id, trap_id, timestamp) of the entries at which frequency traps fire, as :func:`traps.frequency_hits` finds them.

    The time of a trap is cut into cells as wide as its longest window; a cell
    also gets the entries of the cell before it. So a busy team is spread over
    its time, and a cell's state ends when the watermark has left it.
    """
    rules = _active(entries.sparkSession, traps, "FREQUENCY")
    usable = _counting(rules, "FREQUENCY_THRESHOLD").groupBy("trap_id", "team_id").agg(
        F.bool_and(F.col("threshold").isNotNull() & F.col("window_seconds").isNotNull()).alias("usable"),
        F.sort_array(F.collect_list(F.struct(
            (F.col("window_seconds") * F.lit(SECOND)).alias("width"), "threshold", "service", "own_level"))).alias("conditions"),
    ).where("usable").withColumn("widest", F.array_max("conditions.width")).drop("usable")
    always = rules.where(~F.exists("conditions", lambda c: c["condition_type"] == "FREQUENCY_THRESHOLD")).select("trap_id", "team_id")
    id_type = entries.schema["id"].dataType

    counted = F.transform("conditions", lambda c: F.coalesce(
        c["service"].isNull() | ((F.col("service_name") == c["service"]) & (F.col("level") == c["own_level"])), F.lit(False)))
    rows = entries.select("id", "team_id", "service_name", "level", "timestamp").withWatermark("timestamp", late).join(usable, "team_id")
    cell = F.expr("unix_micros(timestamp) div greatest(widest, 1)")
    rows = rows.withColumn("item", F.struct(F.col("id").cast("string").alias("id"), counted.alias("counted"))).withColumn(
        "cell", F.explode(F.array(cell, cell + 1)))
    own = F.col("cell") == cell
    rows = rows.select(
        "trap_id", F.to_json("conditions").alias("conditions"), "cell", "timestamp",
        F.to_json(F.struct(F.when(own, F.col("item.id")).alias("id"), F.col("item.counted").alias("counted"))).alias("item"))

    def step(key: tuple, memory, moment: int, items: Callable[[], list[str]]):
        conditions = json.loads(key[1])
        past = memory or [[[], 0] for _ in conditions]  # per condition: [moment, number] in order, and their sum
        found = [json.loads(i) for i in items()]
        for k, c in enumerate(conditions):
            moments, total = past[k]
            n = sum(f["counted"][k] for f in found)
            if n:
                moments.append([moment, n])
            gone = 0
            while gone < len(moments) and moments[gone][0] < moment - c["width"]:
                total -= moments[gone][1]
                gone += 1
            past[k] = [moments[gone:], total + n]
        fires = all(past[k][1] >= c["threshold"] for k, c in enumerate(conditions))
        return past, [json.dumps({"id": f["id"], "at": moment}) for f in found if fires and f.get("id") is not None]

    def idle(key: tuple, memory, passed: int):
        end = (key[2] + 1) * max(c["width"] for c in json.loads(key[1]))
        return (None, [], None) if passed > end else (memory, [], end)

    fired = replay(rows, ["trap_id", "conditions", "cell"], step, idle)
    made = F.from_json("out", "id string, at bigint")
    fired = fired.select(made.alias("made"), "trap_id").select(
        F.col("made.id").cast(id_type).alias("id"), "trap_id", F.timestamp_micros("made.at").alias("timestamp"))
    return fired.unionByName(entries.join(always, "team_id").select("id", "trap_id", "timestamp"))


def throttle_stream(fires: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The fires that become alerts, as :func:`alerts.throttle` finds them, whatever order they come in.

    A rule remembers its last alert; a fire is judged when the watermark has
    passed it, so one that comes late still stands between its neighbours.
    Only the texts of fires at the moments that are kept are unpacked. Rules without a throttle time let everything through at once.
    """
    whole = F.to_json(F.struct(*fires.columns), _MOMENT).alias("item")
    timed = fires.where("throttle_minutes > 0").withColumn("timestamp", F.col("fired_at")).withWatermark("timestamp", late)
    timed = timed.select("rule_id", F.col("throttle_minutes").cast("long").alias("minutes"), "timestamp", whole)
    numeric = fires.schema["entry_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def step(key: tuple, last, moment: int, items: Callable[[], list[str]]):
        if last is not None and moment < last + key[1] * MINUTE:
            return last, []
        first = min(items(), key=lambda i: int(json.loads(i)["entry_id"]) if numeric else json.loads(i)["entry_id"])
        return moment, [first]

    def idle(key: tuple, last, passed: int):
        # Once the throttle time is over, the last alert has no say any more.
        free = None if last is None else last + key[1] * MINUTE
        return (last, [], free) if free is not None and passed <= free else (None, [], None)

    kept = replay(timed, ["rule_id", "minutes"], step, idle, open_blocks=64)
    kept = kept.select(F.from_json("out", fires.schema, _MOMENT).alias("fire")).select("fire.*")
    return kept.unionByName(fires.where("throttle_minutes <= 0"))


def _one_a_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest time of each part of a batch: enough to wake every rule."""
    newest = None
    for pdf in batches:
        if len(pdf):
            newest = pdf["timestamp"].max() if newest is None else max(newest, pdf["timestamp"].max())
    if newest is not None:
        yield pd.DataFrame({"timestamp": [newest]})


#: Rows of :func:`_ends` that a task holds before it passes them on.
HELD_CELLS = 200_000


def _ends(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: (keys, first, last), the smallest and largest ``at`` of each key and cell that come together in a task."""

    def reduced(tables: Sequence[pa.Table]) -> pa.Table:
        cells = pa.concat_tables(tables).group_by([*keys, "cell"]).aggregate([("first", "min"), ("last", "max")])
        cells = cells.select([*keys, "cell", "first_min", "last_max"])
        return cells.rename_columns([*keys, "cell", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(reduced([pa.Table.from_batches([batch])]))
            size += held[-1].num_rows
            if size >= HELD_CELLS:
                held = [reduced(held)]
                size = held[0].num_rows
                if size >= HELD_CELLS // 2:
                    yield from held[0].drop_columns(["cell"]).to_batches()
                    held, size = [], 0
        if held:
            yield from reduced(held).drop_columns(["cell"]).to_batches()

    return run


def absence_rule_stream(entries: DataFrame, traps: DataFrame | Iterable[Mapping], since, late: str = "10 minutes") -> DataFrame:
    """(team_id, trap_id, condition, absent_from, absent_until): gaps of the absence conditions from ``since`` on.

    The gaps of :func:`traps.absence_gaps`, as they come about: one row without
    ``absent_until`` when the watermark passes the end of a window without
    entries, and one more with it when an entry has ended the gap. Rules whose
    entries never come are woken by the other entries of the stream.

    No gap lies inside a cell of time that is not wider than the rule's window,
    so of each cell only the first and the last entry go to the rule. They are
    found by teams and hours: what a rule holds grows with the time that is
    told of, not with the entries.
    """
    rules = _counting(_active(entries.sparkSession, traps, "ABSENCE"), "ABSENCE").where("window_seconds IS NOT NULL")
    rules = rules.select("team_id", "trap_id", "condition", (F.col("window_seconds") * F.lit(SECOND)).alias("width"), "service", "own_level")
    key = ["team_id", "trap_id", "condition", "width"]
    own = F.col("service").isNull() | F.coalesce((F.col("service_name") == F.col("service")) & (F.col("level") == F.col("own_level")), F.lit(False))
    at = micros(F.col("timestamp"))
    timed = entries.where("timestamp IS NOT NULL")
    seen = timed.select("team_id", "service_name", "level", at.alias("at")).repartition("team_id", F.expr(f"at div {60 * MINUTE}"))
    cells = seen.join(rules, "team_id").where(own).select(
        *key, F.expr("at div greatest(width, 1)").alias("cell"), F.col("at").alias("first"), F.col("at").alias("last"))
    ends = cells.mapInArrow(_ends(key), cells.drop("cell").schema)
    ends = ends.select(*key, F.explode(F.array_distinct(F.array("first", "last"))).alias("at"))
    wake = timed.select("timestamp").mapInPandas(_one_a_batch, "timestamp timestamp")
    rows = ends.select(*key, F.timestamp_micros("at").alias("timestamp"), F.lit("seen").alias("item")).unionByName(
        wake.crossJoin(rules).select(*key, "timestamp", F.lit("wake").alias("item"))).withWatermark("timestamp", late)
    start = entries.sparkSession.range(1).select(micros(instant(since))).first()[0]

    def gap(begins: int, until: int | None) -> str:
        return json.dumps({"begins": begins, "until": until})

    def told(key: tuple, memory, now: int):
        """The memory is [last entry, whether its gap was told]; a gap that begins before ``now`` is told once."""
        last, said = memory or [start - key[3] - 1, False]
        begins = max(last + key[3] + 1, start)
        return [last, said or begins < now], [gap(begins, None)] if begins < now and not said else [], begins

    def step(key: tuple, memory, moment: int, items: Callable[[], list[str]]):
        if "seen" not in items():
            return memory, []
        memory, out, begins = told(key, memory, moment)
        if moment < start:
            return [max(moment, memory[0]), False], []
        return [moment, False], out + ([gap(begins, moment)] if memory[1] else [])

    def idle(key: tuple, memory, passed: int):
        memory, out, begins = told(key, memory, passed - 1000)
        return memory, out, None if memory[1] else begins + 1000

    found = replay(rows, key, step, idle).select(*key, F.from_json("out", "begins bigint, until bigint").alias("gap"))
    return found.select("team_id", "trap_id", "condition", F.timestamp_micros("gap.begins").alias("absent_from"),
                        F.timestamp_micros("gap.until").alias("absent_until"))
