"""Line deduplication by pairwise alignment.

A run is the shortest row of lines from a given line on, or up to a given line,
that holds at least ``MIN_BLOCK`` characters; every line of a block that is worth
deleting stands in a run inside the block. The rarest thing two overlapping
documents share is such a run, so documents are brought together by run hashes: a
document meets, for each of its runs, the first document that has it. That is one
partner per run whatever its frequency, so a line that a third of all documents hold
gives one link per document and no pairs among them.

Each pair is aligned with patience diff on line hashes: lines that occur once in
both, their longest increasing chain, and the same again between the anchors;
stretches without such lines are matched from both ends, and then by the k-th of
equal lines with the k-th, so that a stretch with a common line is never left. Aligned blocks of at
least ``MIN_BLOCK`` characters are deleted from the later document. Alignment keeps the
order of both and sees the whole of the first holder, so it leaves moved blocks, further
copies of a block in one document, and blocks of which the holder has a part. The runs it
leaves give the stretches that are aligned again, by themselves, with the place where the
holder has them. Only aligned lines are deleted, a run alone deletes nothing; together they are
just what lies in a block of at least ``MIN_BLOCK`` characters that any earlier document
has. All is judged on the input, so the first document that has a block always keeps it.

Documents are ordered by id, then by the hash of the text; null ids come last.
Rows that are equal in both are one document and share the outcome. Lines are
split at \\n. A null text has no lines and stays null; an empty text has one empty
line. All other columns stay; an empty table gives an empty result.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField

from tracewell.llm.common import with_columns
from tracewell.storage import keep

MIN_BLOCK = 100  # characters, line ends not counted
LAST = (1 << 63) - 1  # where a null id stands in the order
MIX = np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _llm_id and _llm_tag, by which documents are told apart and ordered."""
    return docs.withColumn("_llm_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("_llm_tag", F.xxhash64(text_col))


def line_arrays(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, tag, hashes, sizes) of each different document with a text."""
    split = F.split(F.col(text_col), "\n", -1)
    return rows.filter(F.col(text_col).isNotNull()).select(
        F.col("_llm_id").alias("id"), F.col("_llm_tag").alias("tag"),
        F.transform(split, lambda line: F.xxhash64(line)).alias("hashes"), F.transform(split, lambda line: F.length(line)).alias("sizes"))


def run_keys(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of the shortest runs of at least ``least`` characters from every line on and up to every line."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + least)  # the first end that is far enough
    starts = np.searchsorted(total, total[1:] - least, "right") - 1  # the last start that is
    ahead, back_from = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    spans = np.unique(np.concatenate([ahead * (n + 1) + ends[ahead], starts[back_from] * (n + 1) + back_from + 1]))
    starts, ends = spans // (n + 1), spans % (n + 1)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, MIX)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, UNMIX)]))
    mixed = hashes ^ (hashes >> np.uint64(31))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:-1], dtype=np.uint64)])
    keys = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * MIX
    return keys ^ (keys >> np.uint64(29)), starts, ends


def runs(arrays: DataFrame, least: int) -> DataFrame:
    """(run, id, tag, start, end): the runs of every document by their hash, with the lines they span."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = batch.column("hashes")[i].values.to_numpy().view(np.uint64)
                sizes = batch.column("sizes")[i].values.to_numpy()
                keys, starts, ends = run_keys(hashes, sizes, least)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), batch.column("id")[i].as_py(), np.int64)),
                        pa.array(np.full(len(keys), batch.column("tag")[i].as_py(), np.int64)),
                        pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["run", "id", "tag", "start", "end"])

    return arrays.mapInArrow(find, "run long, id long, tag long, start int, end int")


def partners(found: DataFrame) -> DataFrame:
    """(id, tag, to_id, to_tag, spans): each document with the first holder of each of its runs, the lines of these and where they begin there."""
    first = found.groupBy("run").agg(F.min(F.struct("id", "tag", "start")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = found.join(first, "run").filter("id <> f.id OR tag <> f.tag")
    return met.groupBy("id", "tag", F.col("f.id").alias("to_id"), F.col("f.tag").alias("to_tag")).agg(
        F.collect_list(F.struct("start", "end", F.col("f.start").alias("to_start"))).alias("spans"))  # of one document


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of (a, b) pairs, ordered by a, in which b rises too."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[i] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def numbered(a: list[int], lo: int, hi: int, b: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """The k-th of equal lines in one stretch with the k-th in the other."""
    places: dict[int, list[int]] = {}
    for j in range(low, high):
        places.setdefault(b[j], []).append(j)
    waiting = {line: iter(at) for line, at in places.items()}
    found = ((i, next(waiting.get(a[i], iter(())), None)) for i in range(lo, hi))
    return [(i, j) for i, j in found if j is not None]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal lines (i, j) of two documents by patience diff, in order."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        lo, hi, low, high = work.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        count_a, count_b = Counter(a[lo:hi]), Counter(b[low:high])
        place = {line: j for j, line in enumerate(b[low:high], low) if count_b[line] == 1}
        anchors = chain([(i, place[line]) for i, line in enumerate(a[lo:hi], lo) if count_a[line] == 1 and line in place])
        if not anchors:
            anchors = chain(numbered(a, lo, hi, b, low, high))
        if not anchors:
            continue
        edges = [(lo - 1, low - 1), *anchors, (hi, high)]
        out.extend(anchors)
        work.extend((x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:]))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], least: int) -> list[int]:
    """Lines of ``a`` in aligned blocks of at least ``least`` characters; a block has no gap on either side."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out.extend(block)
            block = []
        block.append(i)
        last = (i, j)
    return out


def left_stretches(gone: np.ndarray, starts: np.ndarray, ends: np.ndarray, to_starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, shift) of the runs with a line that is not ``gone``; those of one shift that touch are one stretch."""
    kept = np.concatenate([[0], np.cumsum(~gone)])
    open_runs = kept[ends] > kept[starts]
    out: list[tuple[int, int, int]] = []
    for shift, start, end in sorted(zip((starts - to_starts)[open_runs].tolist(), starts[open_runs].tolist(), ends[open_runs].tolist())):
        if out and out[-1][2] == shift and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), shift)
        else:
            out.append((start, end, shift))
    return out


def aligned_lines(a: list[int], b: list[int], sizes: list[int], runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """Lines of ``a`` in aligned blocks, of the whole documents first, then of the stretches of ``runs`` that are left."""
    gone = np.zeros(len(a), bool)
    gone[common_blocks(a, b, sizes, least)] = True
    for start, end, shift in left_stretches(gone, *runs):
        found = common_blocks(a[start:end], b[start - shift:end - shift], sizes[start:end], least)
        gone[[start + i for i in found]] = True
    return np.flatnonzero(gone).astype(np.int32)


def deletions(rows: DataFrame, least: int = MIN_BLOCK) -> DataFrame:
    """(id, tag, deleted): line numbers to delete from each document that loses any; ``rows`` as of ``keyed``."""
    arrays = keep(line_arrays(rows).dropDuplicates(["id", "tag"]))  # hashes and lengths only, some ten bytes a line
    pairs = partners(runs(arrays, least))
    own = pairs.join(arrays, ["id", "tag"]).withColumnRenamed("hashes", "own_hashes")
    other = arrays.select(F.col("id").alias("to_id"), F.col("tag").alias("to_tag"), F.col("hashes").alias("to_hashes"))
    both = own.join(other, ["to_id", "to_tag"]).select("id", "tag", "own_hashes", "sizes", "to_hashes", "spans")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, found = [], [], []
            for row_id, tag, mine, sizes, theirs, spans in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                shared = tuple(spans.values.field(c).to_numpy() for c in ("start", "end", "to_start"))
                ids.append(row_id)
                tags.append(tag)
                found.append(aligned_lines(mine.as_py(), theirs.as_py(), sizes.as_py(), shared, least))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["id", "tag", "deleted"])

    pieces = both.mapInArrow(align, "id long, tag long, deleted array<int>")
    return pieces.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))  # of one document


def matching(rows: DataFrame, found: DataFrame) -> Column:
    return (rows["_llm_id"] == found["_gone_id"]) & (rows["_llm_tag"] == found["_gone_tag"])


def dedup_lines(docs: DataFrame, least: int = MIN_BLOCK) -> DataFrame:
    """``docs`` without the blocks that an earlier document has; adds _llm_deleted, how many lines went."""
    rows = keyed(docs)
    found = keep(deletions(rows, least)).select(F.col("id").alias("_gone_id"), F.col("tag").alias("_gone_tag"), F.col("deleted").alias("_gone"))

    def compute(batch: pa.RecordBatch) -> list:
        texts, counts = [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist()):
            if gone:
                out = set(gone)
                text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in out])
            texts.append(text)
            counts.append(len(gone or ()))
        return [texts, counts]

    joined = rows.join(found.hint("merge"), matching(rows, found), "left")  # the same way at every size; what is found grows with the documents
    done = with_columns(joined, [StructField("_llm_text", StringType()), StructField("_llm_deleted", IntegerType())], compute)
    return done.select(*(F.col("_llm_text").alias("text") if c == "text" else F.col(c) for c in docs.columns), "_llm_deleted", F.col("text").alias("_llm_before"))


def digests(docs: DataFrame, least: int = MIN_BLOCK) -> DataFrame:
    """What each document lost and keeps, as counts and a digest."""
    done = dedup_lines(docs.select("doc_id", "text"), least)
    def lines(c):
        return F.when(F.col(c).isNull(), 0).otherwise(F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit(""))) + 1)
    return done.select(
        "doc_id", lines("_llm_before").cast("long").alias("n_lines"), F.col("_llm_deleted").cast("long").alias("n_deleted"),
        F.coalesce(F.length("_llm_before") - F.length("text"), F.lit(0)).cast("long").alias("chars_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
