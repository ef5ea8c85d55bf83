"""Line deduplication leaves no block behind."""
import random

import numpy as np
from conftest import prose

from tracewell.llm import lines


def test_repeated_passages_are_aligned():
    assert lines.common_blocks([1, 7, 2], [3, 7, 4, 7, 5], [1, 100, 1], 100) == [1]
    assert lines.common_blocks([1, 7, 2, 7, 6], [3, 7, 4], [1, 100, 1, 100, 1], 100) == [1]
    rng = random.Random(4)
    for trial in range(200):
        fresh = iter(range(100, 10_000))
        passages = [[1, 2, 3], [4, 5]]
        a, b = ([line for _ in range(rng.randrange(2, 6)) for line in [next(fresh), *rng.choice(passages), next(fresh)]] for _ in range(2))
        gone = lines.common_blocks(a, b, [50 if line < 10 else 1 for line in a], 100)
        assert bool(gone) == bool(set(a) & set(b))


def test_only_aligned_lines_go():
    a, b, sizes = [1, 2, 3, 4, 9, 5], [5, 7, 3, 4, 1, 2], [60, 60, 60, 60, 5, 60]
    def runs(*rows):
        return tuple(np.array(c, np.int32) for c in zip(*rows))
    assert lines.aligned_lines(a, b, sizes, runs((0, 2, 4), (2, 4, 2)), 100).tolist() == [0, 1, 2, 3]
    assert lines.common_blocks(a, b, sizes, 100) == [2, 3]  # the order of both is kept, so one of two moved blocks is left
    assert lines.aligned_lines([1, 2], [3, 4], [60, 60], runs((0, 2, 0)), 100).tolist() == []  # a run whose lines are not equal
    assert lines.left_stretches(np.zeros(6, bool), *runs((0, 2, 3), (1, 3, 4), (3, 5, 6), (2, 4, 9))) == [(2, 4, -7), (0, 5, -3)]


def brute_left(rows, least):
    """What each document keeps, by all blocks that it has in common with any earlier document."""
    left = {}
    for at, (i, text) in enumerate(rows):
        own, gone = text.split("\n"), set()
        for _, other in rows[:at]:
            theirs = other.split("\n")
            for x in range(len(own)):
                for y in range(len(theirs)):
                    if own[x] != theirs[y] or (x and y and own[x - 1] == theirs[y - 1]):
                        continue
                    n = 0
                    while x + n < len(own) and y + n < len(theirs) and own[x + n] == theirs[y + n]:
                        n += 1
                    if sum(map(len, own[x:x + n])) >= least:
                        gone.update(range(x, x + n))
        left[i] = "\n".join(line for k, line in enumerate(own) if k not in gone)
    return left


def test_blocks_of_any_earlier_document_go(spark):
    rng = random.Random(8)
    p, q = prose(rng, 30), prose(rng, 30)
    rows = [(0, f"a\n{p}\n{q}\nz"), (1, f"b\n{q}\n{p}\ny"), (2, f"c\n{q}\n{p}\nx"), (3, f"d\n{p}\ne\n{p}\nf")]
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in done} == {0: rows[0][1], 1: "b\ny", 2: "c\nx", 3: "d\ne\nf"} == brute_left(rows, 100)


def test_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    pool = [prose(rng, n) for n in (1, 1, 2, 2, 3, 4, 6, 9, 14)] + ["", ""]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(10)]
    rows = []
    for i in range(60):
        own = [line for _ in range(rng.randrange(1, 6)) for line in (rng.choice(passages) if rng.random() < 0.6 else [prose(rng, 4)])]
        rows.append((i, "\n".join(own)))
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    assert {r.doc_id: r.text for r in done} == brute_left(rows, 60)
    assert sum(r._llm_deleted for r in done) > 50
