"""A uniform shuffle into shards of exact sizes, in DataFrame functions only.

Rows are taken from where they lie: the input is written once below the shared folder
with the number of its partition and the place in it, which are fixed from then on,
also when executors are lost. Blocks of at most ``BLOCK`` rows of a partition are the
sources. How many rows each source sends to each shard is drawn first, exactly as a
uniform permutation of all rows would have it: a matrix with the blocks' sizes as row
sums and the shards' sizes as column sums, hypergeometric in every cell. It is drawn
down a tree over the blocks, ``FAN`` children a node, each shard in turn from what the
children and shards before have left, so that no task sees more than a node, and the
driver none of it. Then every block is permuted by itself and cut by its row of the
matrix, the pieces are exchanged, and every shard is permuted again.

A shard may hold any number of rows, so its permutation is made in cells: rows get a
random key, the key's first bits name a cell of some ``CELL`` rows, cells are ordered by
themselves, and one small sum per cell makes the slots gapless over the shard.

Law: ``rows``. Sizes of shards differ by one row at most; shard s of S holds the rows
that the quotient leaves over if s is below the remainder. Randomness is a hash of the
seed and of a row's block and place, so a written input has one result per seed. Rows
are dealt as rows: null, empty, equal and very long texts and null ids make no
difference, and equal rows fall into shards independently, so a group of copies, of any
share of all rows, lies in all shards. An empty table gives an empty result. All columns
stay, whatever their names; those added begin with ``_llm_`` until the end.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import let
from tracewell.storage import cut, keep

SHARDS = 24
BLOCK_BITS, CELL_BITS, FAN_BITS = 18, 17, 4
BLOCK, CELL, FAN = 1 << BLOCK_BITS, 1 << CELL_BITS, 1 << FAN_BITS
PLACE_BITS = 33  # of a monotonically increasing id, within its partition
REACH = 9  # standard deviations on either side of a mean, beyond which no 53-bit number falls


def unit(*parts: Column | int) -> Column:
    """A number in [0, 1) from what names it."""
    return F.shiftrightunsigned(F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts)), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, taken: Column, u: Column) -> Column:
    """How many marked ones are among ``taken`` of ``total``, ``marked`` of which are: the smallest count whose distribution reaches ``u``."""
    def bounds(x: Column) -> Column:
        mean = x["n"] * x["m"] / F.greatest(x["t"], F.lit(1.0))
        spread = F.sqrt(mean * F.greatest(1 - x["m"] / F.greatest(x["t"], F.lit(1.0)), F.lit(0.0)) * (x["t"] - x["n"]) / F.greatest(x["t"] - 1, F.lit(1.0)))
        low = F.greatest(F.lit(0.0), x["n"] + x["m"] - x["t"], F.floor(mean - REACH * spread) - REACH)
        high = F.least(x["n"], x["m"], F.ceil(mean + REACH * spread) + REACH)
        return F.struct(x["t"], x["m"], x["n"], x["u"], low.cast("long").alias("low"), high.cast("long").alias("high"))

    def weighed(x: Column) -> Column:
        counts = F.sequence(x["low"], x["high"])

        def ratio(k: Column) -> Column:
            """The chance of k + 1 over that of k."""
            return (x["m"] - k) * (x["n"] - k) / ((k + 1) * (x["t"] - x["m"] - x["n"] + k + 1))

        def add(acc: Column, k: Column) -> Column:
            return F.struct((acc["w"] * ratio(k)).alias("w"), (acc["s"] + acc["w"]).alias("s"))

        def pick(level: Column) -> Column:
            def step(acc: Column, k: Column) -> Column:
                s = acc["s"] + acc["w"]
                return F.struct((acc["w"] * ratio(k)).alias("w"), s.alias("s"), (acc["x"] + F.when(s <= level, 1).otherwise(0)).alias("x"))

            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("x"))
            return F.least(x["low"] + F.aggregate(counts, start, lambda acc, k: step(acc, k), lambda acc: acc["x"]).cast("long"), x["high"])

        whole = F.aggregate(counts, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")), lambda acc, k: add(acc, k), lambda acc: acc["s"])
        return let(whole * x["u"], pick)

    named = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), taken.cast("double").alias("n"), u.alias("u"))
    return let(let(named, bounds), weighed)


def dealt(room: Column, taken: Column, *name: Column | int) -> Column:
    """How many of ``taken`` rows go to each shard, with ``room`` rows still open in each."""
    def one(acc: Column, shard: Column) -> Column:
        def put(k: Column) -> Column:
            return F.struct((acc["left"] - k).alias("left"), (acc["open"] - F.get(room, shard)).alias("open"), F.concat(acc["got"], F.array(k)).alias("got"))

        return let(hypergeometric(acc["open"], F.get(room, shard), acc["left"], unit(*name, shard)), put)

    everything = F.aggregate(room, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(taken.alias("left"), everything.alias("open"), F.array().cast("array<long>").alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, one, lambda acc: acc["got"])


def split(room: Column, children: Column, level: int, seed: int) -> Column:
    """Array of (no, room): each child's share of its parent's rows in every shard, children one after the other."""
    def one(acc: Column, child: Column) -> Column:
        def give(got: Column) -> Column:
            return F.struct(F.zip_with(acc["room"], got, lambda a, b: a - b).alias("room"),
                            F.concat(acc["out"], F.array(F.struct(child["no"].alias("no"), got.alias("room")))).alias("out"))

        return let(dealt(acc["room"], child["n"], seed, level, child["no"]), give)

    start = F.struct(room.alias("room"), F.array().cast("array<struct<no:long,room:array<long>>>").alias("out"))
    return F.aggregate(children, start, one, lambda acc: acc["out"])


def even(total: Column, shards: int) -> Column:
    """Sizes of shards, at most one apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr("1L") * F.floor(total / shards) + F.when(s < F.pmod(total, F.lit(shards)), 1).otherwise(0))


def communication(sizes: DataFrame, shards: int, seed: int, last: int) -> DataFrame:
    """(no, room): how many rows each block of ``sizes`` (no, n) sends to each shard; ``last`` is the largest no."""
    levels, below = [], sizes
    while not levels or last >> (FAN_BITS * len(levels)):
        children = F.array_sort(F.collect_list(F.struct("no", "n"))).alias("children")  # FAN at most
        below = below.groupBy(F.shiftright("no", FAN_BITS).alias("no")).agg(F.sum("n").alias("n"), children)
        levels.append(below)
    nodes = levels[-1].select("no", even(F.col("n"), shards).alias("room"))
    for level in reversed(range(len(levels))):
        both = nodes.join(levels[level].select("no", "children"), "no")
        nodes = cut(both.select(F.explode(split(F.col("room"), F.col("children"), level, seed)).alias("c")).select("c.no", "c.room"))
    return nodes


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniform permutation of all rows, cut into shards of equal size; slots are gapless from 0."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)
    rows = keep(docs.select("*", F.spark_partition_id().cast("long").alias("_llm_part"), place.alias("_llm_at")))
    sub = F.shiftright("_llm_at", BLOCK_BITS)
    counted = cut(rows.groupBy(F.col("_llm_part").alias("part"), sub.alias("sub")).agg(F.count(F.lit(1)).alias("n")))
    most = counted.agg(F.max("part").alias("part"), F.max("sub").alias("sub"), F.sum("n").alias("n")).first()
    if most["n"] is None:
        return docs.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    per = most["sub"] + 1
    matrix = communication(counted.select((F.col("part") * per + F.col("sub")).alias("no"), "n"), shards, seed, (most["part"] + 1) * per - 1)

    # every block permuted by itself, and cut by its row of the matrix
    block = F.col("_llm_part") * per + sub
    local = Window.partitionBy("_llm_no").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "_llm_no", "_llm_at"), "_llm_at")
    ranked = rows.withColumn("_llm_no", block).withColumn("_llm_rank", F.row_number().over(local) - 1)
    ends = F.expr("transform(sequence(1, size(room)), i -> aggregate(slice(room, 1, i), 0L, (a, b) -> a + b))")
    cuts = matrix.select(F.col("no").alias("_llm_no"), ends.alias("_llm_ends"))
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "_llm_no", "_llm_at")
    bits = max(0, (most["n"] // (shards * CELL)).bit_length())
    cell = F.shiftrightunsigned("_llm_key", 64 - bits).cast("int") if bits else F.lit(0)
    sent = ranked.join(cuts, "_llm_no").withColumn("_llm_shard", F.size(F.filter("_llm_ends", lambda e: e <= F.col("_llm_rank"))))
    sent = keep(sent.withColumn("_llm_key", key).withColumn("_llm_cell", cell).drop("_llm_ends", "_llm_rank", "_llm_part"))

    # the exchange, and every shard permuted again
    cells = sent.groupBy("_llm_shard", "_llm_cell").agg(F.count(F.lit(1)).alias("_llm_n"))
    before = Window.partitionBy("_llm_shard").orderBy("_llm_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_llm_shard", "_llm_cell", F.coalesce(F.sum("_llm_n").over(before), F.lit(0)).alias("_llm_start"))
    within = Window.partitionBy("_llm_shard", "_llm_cell").orderBy("_llm_key", "_llm_no", "_llm_at")
    placed = sent.withColumn("_llm_row", F.row_number().over(within) - 1).join(starts, ["_llm_shard", "_llm_cell"])
    return placed.select(*docs.columns, F.col("_llm_shard").alias("shard"), (F.col("_llm_start") + F.col("_llm_row")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 1) -> None:
    """The shuffled rows as Parquet, a folder per shard and files in the order of slots.

    A column of the input that is called ``shard`` or ``slot`` must be renamed first.
    """
    placed = shuffled(docs, shards, seed)
    range_of = F.shiftright("slot", CELL_BITS)
    placed.withColumn("_llm_file", range_of).repartition("shard", "_llm_file").sortWithinPartitions("shard", "slot").drop("_llm_file").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame) -> DataFrame:
    """Where each document goes, with its size and checksum; texts are read once and not moved."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffled(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
