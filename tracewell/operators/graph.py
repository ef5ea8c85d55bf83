"""Lineage graph: nodes, edges, merging, walks and reachability.

Edges are frames of (src, dst) plus attributes. Walks advance level by level;
every level is cut from the plan on reliable storage. The edges of a node with
very many neighbours are dealt over several tasks in each step.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.skew import lookup_join
from tracewell.storage import cut

ARROW = " -> "


def table_name_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) as dotted names from the four-column form."""
    return edges.select(F.concat_ws(".", "src_db", "src_table").alias("src"), F.concat_ws(".", "dst_db", "dst_table").alias("dst"))


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ends of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def exists_flag(probes: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Probes with ``found`` 0/1."""
    marked = lookup_join(probes, known.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return marked.withColumn("found", F.coalesce("_hit", F.lit(0))).drop("_hit")


def merge_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old nodes as they are plus the new ones not seen before."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both sides; properties of the new side win. Columns (src, dst, props)."""
    return (old.withColumnRenamed("props", "_old").join(new.withColumnRenamed("props", "_new"), ["src", "dst"], "full")
            .select("src", "dst", F.coalesce("_new", "_old").alias("props")))


def degrees(edges: DataFrame) -> DataFrame:
    """(name, n_in, n_out, kind): root without inputs, leaf without outputs."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("name").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return counted.withColumn("kind", F.when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("inner"))


def numbered_starts(starts: DataFrame) -> DataFrame:
    """(start, batch, bit): distinct starts in batches of up to 64, each with a bit of its own."""
    numbers = starts.filter("start IS NOT NULL").select("start").distinct().withColumn("_n", F.monotonically_increasing_id())
    return cut(numbers.select("start", F.expr("_n div 64").alias("batch"), F.expr("cast(_n % 64 as int)").alias("bit")))


def reach_levels(edges: DataFrame, numbered: DataFrame) -> list[DataFrame]:
    """One frame (batch, name, bits) per distance from 0 on: the starts of a batch that reach a node first there, as bits.

    A row stands for up to 64 starts, rows of a node are made one with OR before and after
    the shuffle, and a node is expanded once per start.
    """
    distinct_edges = cut(edges.select("src", "dst").distinct())
    levels = [cut(numbered.groupBy("batch", F.col("start").alias("name")).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))]
    while True:
        frontier = levels[-1].withColumnRenamed("name", "src")
        step = lookup_join(distinct_edges, frontier, ["src"]).select("batch", F.col("dst").alias("name"), F.col("bits").alias("_new"), F.lit(0).cast("long").alias("_old"))
        seen = reduce(DataFrame.unionByName, levels).select("batch", "name", F.lit(0).cast("long").alias("_new"), F.col("bits").alias("_old"))
        merged = step.unionByName(seen).groupBy("batch", "name").agg(F.bit_or("_new").alias("_new"), F.bit_or("_old").alias("_old"))
        fresh = cut(merged.select("batch", "name", F.expr("_new & ~_old").alias("bits")).filter("bits <> 0"))
        if fresh.isEmpty():
            return levels
        levels.append(fresh)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, name, distance): shortest distances from every start, cycles included.

    ``starts`` has a column ``start``. The walk goes with 64 starts in a row; a row per
    start and node is made of the result only.
    """
    numbered = numbered_starts(starts)
    levels = [level.withColumn("distance", F.lit(at)) for at, level in enumerate(reach_levels(edges, numbered)) if at]
    if not levels:
        return numbered.limit(0).select("start", F.col("start").alias("name"), F.lit(0).alias("distance"))
    single = reduce(DataFrame.unionByName, levels).select(
        "batch", "name", "distance", F.explode(F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(bits, b) & 1L = 1L)")).alias("bit"))
    return lookup_join(single, numbered, ["batch", "bit"]).select("start", "name", "distance")


def reaches(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (src, dst, ..) with ``found``: does a walk of one edge or more that does not end where it starts lead from src to dst?

    Probes look up the bit of their start at their end; pairs that nobody asks for are never rows.
    """
    numbered = numbered_starts(probes.select(F.col("src").alias("start")))
    first, *later = reach_levels(edges, numbered)
    ends = reduce(DataFrame.unionByName, later) if later else first.limit(0)
    bits = cut(ends.groupBy("batch", F.col("name").alias("dst")).agg(F.bit_or("bits").alias("_bits")))
    known = lookup_join(probes, numbered.withColumnRenamed("start", "src"), ["src"], "left")
    marked = lookup_join(known, bits, ["batch", "dst"], "left")
    return marked.withColumn("found", F.coalesce(F.expr("shiftrightunsigned(_bits, bit) & 1L = 1L"), F.lit(False))).drop("_bits", "batch", "bit")


def _walk(edges: DataFrame, start: str, depth: int, limit: int | None, forward: bool, inside: DataFrame | None = None) -> DataFrame:
    """Walks of 1..depth edges from ``start`` that use no edge twice; ``edges`` are distinct.

    With a limit only the first ``limit`` walks of a level (in text order) go
    on: whatever grows out of a later one sorts behind them all, so the first
    ``limit`` walks overall are still exact.
    """
    steps = edges if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    frontier = edges.sparkSession.range(1).select(F.lit(start).alias("src"), F.lit(start).alias("walk"), F.array().cast("array<string>").alias("used"))
    levels = []
    for level in range(1, depth + 1):
        edge = F.concat_ws(ARROW, "src", "dst")
        grown = lookup_join(steps, frontier, ["src"]).filter(~F.array_contains("used", edge))
        grown = grown.select(F.col("dst").alias("src"), F.concat_ws(ARROW, "walk", "dst").alias("walk"), F.array_append("used", edge).alias("used"))
        if inside is not None:
            near = inside.filter(F.col("distance") <= depth - level).select(F.col("name").alias("src"))
            grown = grown.join(near, "src", "left_semi")
        if limit is not None:
            grown = grown.orderBy("walk").limit(limit)
        frontier = cut(grown)
        levels.append(frontier.select("walk", F.col("src").alias("last"), F.lit(level).alias("depth")))
    return reduce(DataFrame.unionByName, levels)


def _onward(edges: DataFrame, target: str, near: DataFrame, depth: int, width: int) -> DataFrame:
    """(src, walk, used): the first ``width`` walks from nodes on to ``target``, the node itself not written.

    Made backwards: the first walks with one edge more are an edge before the first
    walks of the node it leads to. ``near`` holds how far nodes are from the source; only
    those that a walk of ``depth`` edges can still use get rows, at most ``width`` + 1 each. A
    row without ``used`` says that walks from this text on are not known: what lay behind
    it was left out, here or at a node further on.
    """
    edge = F.concat_ws(ARROW, "src", "dst")
    last = edges.filter(F.col("dst") == target).select("src", F.col("dst").alias("walk"), F.array(edge).alias("used"))
    order = Window.partitionBy("src").orderBy("walk", F.col("used").isNotNull())
    onward = None
    for left in range(1, depth + 1):
        grown = last
        if onward is not None:
            longer = lookup_join(edges, onward.withColumnRenamed("src", "dst"), ["dst"])
            longer = longer.filter(F.coalesce(~F.array_contains("used", edge), F.lit(True)))
            grown = last.unionByName(longer.select("src", F.concat_ws(ARROW, "dst", "walk").alias("walk"), F.array_append("used", edge).alias("used")))
        grown = grown.join(near.filter(F.col("distance") <= depth - left).select(F.col("name").alias("src")), "src", "left_semi")
        first = grown.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= width + 1)
        first = first.withColumn("used", F.when(F.col("_n") <= width, F.col("used")))
        open_from = F.min(F.when(F.col("used").isNull(), F.col("_n"))).over(Window.partitionBy("src"))
        onward = cut(first.withColumn("_open", open_from).filter("_open IS NULL OR _n <= _open").select("src", "walk", "used"))
    return onward


def _between(edges: DataFrame, source: str, target: str, depth: int, limit: int) -> DataFrame:
    """(walk, depth) of the first ``limit`` walks between two nodes.

    Walks that use an edge twice fall out on the way, so the lists kept per node may
    not reach far enough; they are then made four times as long, until the source has
    ``limit`` walks or nothing was left out that could come before them.
    """
    near = reachable_within(edges, edges.sparkSession.range(1).select(F.lit(source).alias("start")), depth - 1)
    width = 2 * max(limit, 1)
    while True:
        onward = _onward(edges, target, near, depth, width).filter(F.col("src") == source)
        known, left_out = onward.agg(F.count("used"), F.count(F.when(F.col("used").isNull(), 1))).first()  # one list
        if known >= limit or not left_out:
            break
        width *= 4
    return onward.filter("used IS NOT NULL").select(F.concat_ws(ARROW, "src", "walk").alias("walk"), F.size("used").alias("depth"))


def search(edges: DataFrame, source: str | None = None, target: str | None = None, depth: int = 1, limit: int | None = 10) -> DataFrame:
    """(path, depth) of the walks leaving ``source``, arriving at ``target``, or between them.

    The walks are those of 1..depth edges without a repeated edge; the first
    ``limit`` in the order in which they are written from the given end.
    """
    if source is None and target is None:
        raise ValueError("a search needs a source or a target table")
    if depth < 1:
        raise ValueError("depth must be at least 1")
    edges = cut(edges.select("src", "dst").distinct())
    if source is not None and target is not None and limit is not None:
        found = _between(edges, source, target, depth, limit)
    elif source is not None and target is not None:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        target_row = edges.sparkSession.range(1).select(F.lit(target).alias("start"))
        inside = reachable_within(back, target_row, depth)
        found = _walk(edges, source, depth, None, True, inside).filter(F.col("last") == target)
    else:
        found = _walk(edges, source or target, depth, limit, source is not None)
    if limit is not None:
        found = found.orderBy("walk").limit(limit)
    if source is None:
        nodes_in_order = F.reverse(F.split("walk", ARROW))
        return found.select(F.array_join(nodes_in_order, ARROW).alias("path"), "depth")
    return found.select(F.col("walk").alias("path"), "depth")


def reachable_within(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(name, distance) of nodes at most ``depth`` steps away, the start at 0."""
    frontier = starts.select(F.col("start").alias("name"))
    out = cut(frontier.withColumn("distance", F.lit(0)))
    for distance in range(1, depth + 1):
        last = out.filter(F.col("distance") == distance - 1).select(F.col("name").alias("src"))
        fresh = lookup_join(edges, last, ["src"]).select(F.col("dst").alias("name")).distinct()
        out = cut(out.unionByName(fresh.join(out, "name", "left_anti").withColumn("distance", F.lit(distance))))
    return out
