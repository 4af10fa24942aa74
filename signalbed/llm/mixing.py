"""Mixing sources to target weights by a low-discrepancy schedule (operator 13).

The mix is a row of slots. Slot i has the van der Corput point of i, its binary
digits mirrored behind the point; the point falls into one source's part of the
cumulative targets, so every stretch of the schedule holds each source in
proportion. The slots of a source are ranked. Its documents, shuffled by a
hash, lie end to end on a line of words, once for each pass over the source;
the words that the target asks for are cut into as many blocks of equal size as
the source has slots, and block r is joined to the slot of rank r.

Running sums and ranks never put a source into one window: their order is a
hash or a mirrored number, cut into ``CELLS`` cells by its leading digits, so
there is one window over the cells and one inside each. Rows that agree in all
that counts are one row with a number until the words have been laid out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbed.session import cut_lineage

#: Weights of the sources in the order of their code points, repeated; the part of a source without a name comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix in percent of the words there are; most passes over a source.
MIX_PERCENT, MOST_PASSES = 150, 2
#: A block has this many words or up to twice as many.
BLOCK_WORDS = 512
#: Leading hexadecimal digits of a shuffle key, and leading binary digits of a mirrored slot, that name a cell.
CELL_DIGITS, CELL_BITS = 3, 12
#: Rows made at once from one row with a number.
ROWS_AT_ONCE = 65_536


#: Most sources whose sizes and targets are broadcast; more are joined by a shuffle that adaptive execution may split.
BROADCAST_SOURCES = 10_000


def _per_source(table: DataFrame) -> DataFrame:
    """A written table with a row per source, broadcast where it is known to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def size_of(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def running(df: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key before each row, in the order of ``cell``, then ``order``."""
    rows = df.withColumn("_cell", cell).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(F.sum("_value").alias("_sum"))
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_past"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return rows.join(cells.hint("shuffle_merge"), [*keys, "_cell"]).withColumn(out, F.col("_inside") + F.col("_past")).drop("_cell", "_value", "_inside", "_past")


def repeated(df: DataFrame, number: str, out: str) -> DataFrame:
    """Every row ``number`` times, with 0, 1, ... in ``out``; large numbers are spread over tasks."""
    parts = F.expr(f"sequence(0L, ({number} - 1) div {ROWS_AT_ONCE})")
    spread = df.where(F.col(number) > 0).withColumn("_part", F.explode(parts)).repartition(*df.columns, "_part")
    last = F.least(F.col(number) - F.col("_part") * ROWS_AT_ONCE, F.lit(ROWS_AT_ONCE)) - 1
    return spread.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        out, F.col("_part") * ROWS_AT_ONCE + F.col("_at")).drop("_part", "_at")


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``n``, the place of each source in the order of code points from 0, a null last, by ranges."""
    ordered = cut_lineage(sources.repartitionByRange(F.col("source").isNull(), "source")
                          .sortWithinPartitions(F.col("source").isNull(), "source").withColumn("_range", F.spark_partition_id()))
    ranges = ordered.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_past"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").isNull(), "source")
    return ordered.withColumn("_inside", F.row_number().over(inside) - 1).join(ranges, "_range").select(
        *sources.columns, (F.col("_inside") + F.col("_past")).alias("n"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = MIX_PERCENT, passes: int = MOST_PASSES) -> DataFrame:
    """(source, n, source_size, target) from one row per source (``source source_size``).

    ``percent`` of all words are shared by weight; a target stops at ``passes``
    times its source's size, and what is too much is shared anew among the
    others, until none is above. Each round asks the sources for three numbers.
    """
    by_place = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    shares = cut_lineage(numbered(sizes).withColumn("weight", by_place).withColumn("full", F.lit(False)))
    most = F.col("source_size") * passes
    wanted = (shares.agg(F.sum("source_size")).first()[0] or 0) * percent
    while True:
        stopped, n_full, weights_left = shares.agg(
            F.sum(F.when(F.col("full"), most)), F.count_if("full"), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        rest, weights_left = max(wanted - 100 * (stopped or 0), 0), weights_left or 1
        # Whole numbers on both sides, so that no rounding decides who is above; decimals, as products may pass 64 bits.
        above = (F.col("weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(24,0)")
                 > (most * 100).cast("decimal(24,0)") * F.lit(weights_left).cast("decimal(12,0)"))
        marked = cut_lineage(shares.withColumn("full", F.col("full") | above))
        if marked.where("full").count() == n_full:
            break
        shares = marked
    share_of = F.col("weight") * F.lit(float(rest)) / F.lit(float(100 * weights_left))
    target = F.when(F.col("full"), most.cast("double")).otherwise(share_of)
    return shares.select("source", "n", "source_size", target.alias("target"))


def slots_of(shares: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """((n, words, slots) of each source, (n, slot, rank) of the schedule) for ``shares`` (``n target``).

    There are 2^k slots. Point g + 1/2 of that grid belongs to the source in
    whose part of the cumulative targets it lies; its place in the schedule is g
    with mirrored digits. A source whose part holds no point has the slot that
    its part lies in, beside the owner.
    """
    shares = cut_lineage(shares.select("n", "target", F.round("target").cast("bigint").alias("words")))
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    bits = max(int(total / block_words).bit_length() - 1, 0)
    end = _cumulative(shares)
    grid = F.lit(float(1 << bits)) / F.lit(total or 1.0)
    # A boundary at c lies behind the points g + 1/2 < c.
    parts = end.withColumn("_from", F.least(F.ceil(F.col("_before") * grid - 0.5), F.lit(1 << bits)).cast("bigint"))
    parts = parts.withColumn("_to", F.least(F.ceil((F.col("_before") + F.col("target")) * grid - 0.5), F.lit(1 << bits)).cast("bigint"))
    own = F.col("_to") - F.col("_from")
    parts = parts.where("words > 0").select(
        "n", "words", F.when(own > 0, F.col("_from")).otherwise(F.least(F.floor(F.col("_before") * grid), F.lit((1 << bits) - 1))).alias("_from"),
        F.greatest(own, F.lit(1)).alias("slots"))
    parts = cut_lineage(parts)
    grid_points = repeated(parts, "slots", "_k").withColumn("_g", F.col("_from") + F.col("_k"))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("_g"), bits, "0")), 2, 10).cast("bigint") if bits else F.lit(0).cast("bigint")
    slots = grid_points.select("n", mirrored.alias("slot"))
    slots = running(slots, ["n"], F.shiftright("slot", max(bits - CELL_BITS, 0)), ["slot"], F.lit(1).cast("bigint"), "rank")
    return parts.select("n", "words", "slots"), slots


def _cumulative(shares: DataFrame) -> DataFrame:
    """Add ``_before``, the targets of the sources before each; groups of sources first, then inside the groups."""
    groups = shares.withColumn("_group", F.expr("n div 4096"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    past = groups.groupBy("_group").agg(F.sum("target").alias("_sum")).select(
        "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_past"))
    return groups.withColumn("_inside", F.coalesce(F.sum("target").over(inside), F.lit(0.0))).join(past, "_group").withColumn(
        "_before", F.col("_inside") + F.col("_past")).drop("_group", "_inside", "_past")


def laid_out(docs: DataFrame) -> DataFrame:
    """(n, doc_id, size, start) of every row of ``docs`` (``n doc_id size``) with words: its place on its source's line."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    alike = docs.where("size > 0").groupBy("n", "doc_id", "size").agg(F.count("*").alias("rows")).withColumn("key", key)
    alike = running(alike, ["n"], F.substring("key", 1, CELL_DIGITS), ["key", "doc_id", "size"], F.col("rows") * F.col("size"), "_start")
    several = repeated(alike.where("rows > 1").select("n", "doc_id", "size", "_start", "rows"), "rows", "_k")
    return (alike.where("rows = 1").select("n", "doc_id", "size", F.col("_start").alias("start"))
            .unionByName(several.select("n", "doc_id", "size", (F.col("_start") + F.col("_k") * F.col("size")).alias("start"))))


def _with_sources(docs: DataFrame, weights: Sequence[int], percent: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (source, doc_id, size), written once, and the targets of their sources."""
    rows = cut_lineage(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"),
                                   size_of("text").alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, cut_lineage(targets(sizes, weights, percent, passes))


def _lines(rows: DataFrame, shares: DataFrame) -> DataFrame:
    numbers = _per_source(shares.select(F.col("source").alias("_source"), "n"))
    return cut_lineage(laid_out(rows.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).select("n", "doc_id", "size")))


def _pieces(lines: DataFrame, shares: DataFrame, passes: int, block_words: int) -> DataFrame:
    parts, slots = slots_of(shares, block_words)
    lines = lines.join(_per_source(parts), "n").join(_per_source(shares.select("n", "source_size")), "n")
    # A copy of the line for each pass, as far as the target goes.
    copies = lines.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "_from", F.col("start") + F.col("_pass") * F.col("source_size")).withColumn("_to", F.least(F.col("_from") + F.col("size"), "words"))
    # The first words % slots blocks have one word more than the others.
    copies = copies.where("_from < _to").selectExpr("*", "words div slots AS _q", "words % slots AS _r")
    block = "CASE WHEN {0} < _r * (_q + 1) THEN {0} div (_q + 1) ELSE _r + ({0} - _r * (_q + 1)) div _q END"
    blocks = copies.withColumn("rank", F.explode(F.expr(f"sequence({block.format('_from')}, {block.format('(_to - 1)')})")))
    blocks = blocks.withColumn("_begin", F.expr("rank * _q + least(rank, _r)")).withColumn("_end", F.expr("_begin + _q + IF(rank < _r, 1, 0)"))
    pieces = blocks.select(
        "n", "rank", "doc_id", "size", "start", F.col("_pass").alias("pass"),
        (F.greatest("_begin", "_from") - F.col("_from")).alias("first_word"),
        (F.least("_end", "_to") - F.col("_from")).alias("end_word"),
        F.greatest("_from", "_begin").alias("at"))
    # Both sides grow with the words, though their plans look small: they are shuffled, never broadcast.
    return pieces.join(slots.hint("shuffle_merge"), ["n", "rank"])


def schedule(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = MIX_PERCENT, passes: int = MOST_PASSES,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix of ``docs`` (``doc_id source text``) as pieces: ``slot source pass doc_id first_word end_word at``.

    Reading the pieces by ``slot``, then ``source`` and ``at`` gives the mix;
    words count from 0, the end is exclusive, and ``at`` is the place on the
    source's line. The words taken of a source are its target, rounded. Every
    row is a document; rows without words give no piece, rows without a source
    are one source, and rows that agree in source, id and size are told apart by
    their places only. Other columns are ignored.
    """
    rows, shares = _with_sources(docs, weights, percent, passes)
    names = shares.select("n", "source")
    return _pieces(_lines(rows, shares), shares, passes, block_words).join(names, "n").select(
        "slot", "source", "pass", "doc_id", "first_word", "end_word", "at")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = MIX_PERCENT, passes: int = MOST_PASSES,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id size source_size target taken`` of every row of ``docs``; ``taken`` sums the pieces of :func:`schedule`.

    A row without words takes none. Tables without rows give none; where all
    texts are empty, sizes and targets are 0.
    """
    rows, shares = _with_sources(docs, weights, percent, passes)
    lines = _lines(rows, shares)
    taken = _pieces(lines, shares, passes, block_words).groupBy("n", "start").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("taken"))
    with_words = lines.join(taken.hint("shuffle_merge"), ["n", "start"], "left")
    numbers = _per_source(shares.select(F.col("source").alias("_source"), "n"))
    none = rows.where("size = 0").join(numbers, F.col("source").eqNullSafe(F.col("_source"))).select(
        "n", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
    return (with_words.select("n", "doc_id", "size", "taken").unionByName(none).join(_per_source(shares.select("n", "source_size", "target")), "n")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def op13_mixing(spark, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(spark.read.parquet(f"{folder}/documents.parquet"))


OP13_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM sizes),
-- Sources that stop first come first: each is held against the share that is left where all before it have stopped.
ordered AS (
  SELECT *, coalesce(sum(CAST(2 * source_size AS HUGEINT)) OVER before, 0) AS stopped, sum(weight) OVER behind AS weights,
    sum(CAST(source_size AS HUGEINT)) OVER () AS total
  FROM weighed
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    behind AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
judged AS (SELECT *, weight * (150 * total - 100 * stopped) > 100 * CAST(2 * source_size AS HUGEINT) * weights AS full_ FROM ordered),
rest AS (
  SELECT 150 * any_value(total) - 100 * coalesce(sum(CAST(2 * source_size AS HUGEINT)) FILTER (full_), 0) AS words_left,
    sum(weight) FILTER (NOT full_) AS weights_left
  FROM judged),
shares AS (
  SELECT source, source_size,
    CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE) ELSE weight * CAST(words_left AS DOUBLE) / CAST(100 * weights_left AS DOUBLE) END AS target
  FROM judged, rest),
-- The same line of shuffled documents; what lies before the target's end on a first and a second pass.
lines AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS words,
    CAST(sum(size) OVER (PARTITION BY docs.source
      ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
  FROM docs JOIN shares ON docs.source IS NOT DISTINCT FROM shares.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(start + size, words) - start, 0) + greatest(least(start + size + source_size, words) - start - source_size, 0) AS BIGINT) AS taken
FROM lines
"""
