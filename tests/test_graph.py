"""Walks, reachability and merging on small graphs."""
import itertools
import random

import pytest

from tracewell.operators import graph as G


@pytest.fixture(scope="module")
def cyclic(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("a", "b")], "src string, dst string")


def paths(df):
    return [(r["path"], r["depth"]) for r in df.collect()]


def test_walks_use_no_edge_twice(cyclic):
    got = paths(G.search(cyclic, source="a", depth=6, limit=None))
    assert sorted(got) == [("a -> b", 1), ("a -> b -> c", 2), ("a -> b -> c -> a", 3), ("a -> b -> d", 2)]


def test_upstream_and_between(cyclic):
    assert sorted(paths(G.search(cyclic, target="d", depth=2, limit=None))) == [("a -> b -> d", 2), ("b -> d", 1)]
    assert paths(G.search(cyclic, source="c", target="d", depth=3, limit=None)) == [("c -> a -> b -> d", 3)]
    assert paths(G.search(cyclic, source="c", target="d", depth=2, limit=None)) == []


def test_defaults_are_one_step_and_ten_walks(spark):
    edges = spark.createDataFrame([("hub", f"n{i:02d}") for i in range(30)] + [("n00", "x")], "src string, dst string")
    assert paths(G.search(edges, source="hub")) == [(f"hub -> n{i:02d}", 1) for i in range(10)]


def test_the_limit_keeps_the_first_walks(spark):
    edges = spark.createDataFrame([("s", f"m{i}") for i in range(6)] + [(f"m{i}", f"t{j}") for i in range(6) for j in range(4)], "src string, dst string")
    every = sorted(paths(G.search(edges, source="s", depth=2, limit=None)))
    assert paths(G.search(edges, source="s", depth=2, limit=7)) == every[:7]


def walks_between(edges, source, target, depth):
    """All walks of up to ``depth`` edges that use no edge twice, as texts with their lengths, in text order for names of one length."""
    def onward(node, text, used):
        for a, b in sorted(edges):
            if a == node and (a, b) not in used and len(used) < depth:
                if b == target:
                    yield f"{text} -> {b}", len(used) + 1
                yield from onward(b, f"{text} -> {b}", used | {(a, b)})

    yield from onward(source, source, frozenset())


def test_first_walks_between_equal_all_walks(spark):
    rng = random.Random(3)
    for n, m, depth in ((4, 7, 5), (3, 9, 9)):
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)} | {("n0", "n1")}
        frame = spark.createDataFrame(sorted(edges), "src string, dst string")
        every = list(walks_between(edges, "n0", "n1", depth))
        assert every == sorted(every)
        for limit in (5, 10_000):
            assert paths(G.search(frame, source="n0", target="n1", depth=depth, limit=limit)) == every[:limit]
    assert paths(G.search(frame, source="n0", target="none", depth=3, limit=5)) == []
    assert G.search(frame, source="n0", target="n1", depth=2, limit=0).count() == 0


def test_first_walks_keep_few_rows_of_very_many(spark):
    """Eight nodes with edges both ways between all: over five million walks of up to eight edges, but at most 2 x 10 + 1 rows a node."""
    names = [f"n{i}" for i in range(8)]
    edges = G.cut(spark.createDataFrame([(a, b) for a in names for b in names if a != b], "src string, dst string"))
    near = G.reachable_within(edges, spark.createDataFrame([("n0",)], "start string"), 7)
    rows = G._onward(edges, "n7", near, 8, 20).groupBy("src").count().collect()
    assert rows and all(r["count"] <= 21 for r in rows)
    every = walks_between({tuple(r) for r in edges.collect()}, "n0", "n7", 8)
    assert paths(G.search(edges, source="n0", target="n7", depth=8, limit=10)) == list(itertools.islice(every, 10))


def test_search_needs_an_end(cyclic):
    with pytest.raises(ValueError):
        G.search(cyclic)
    with pytest.raises(ValueError):
        G.search(cyclic, source="a", depth=0)


def test_reachable_stops_on_cycles(cyclic, spark):
    starts = spark.createDataFrame([("a",), ("d",)], "start string")
    got = {(r["start"], r["name"], r["distance"]) for r in G.reachable(cyclic, starts).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2)}


def test_reach_goes_with_64_starts_in_a_row(spark):
    """A ring of 12 nodes with a chord, all of them starts: rows per level go with batches and nodes, not with starts."""
    pairs = [(i, (i + 1) % 12) for i in range(12)] + [(0, 6)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    starts = G.cut(spark.createDataFrame([(f"n{i}",) for i in range(0, 12, 2)] + [(None,)], "start string").coalesce(1))

    def distances(start):
        far, work = {start: 0}, [start]
        for a in work:
            for x, b in pairs:
                if x == a and b not in far:
                    far[b] = far[a] + 1
                    work.append(b)
        return far

    short = G.cut(edges.filter("src NOT IN ('n9')"))
    pairs = [(a, b) for a, b in pairs if a != 9]
    want = {(f"n{s}", f"n{b}", d) for s in range(0, 12, 2) for b, d in distances(s).items() if d}
    assert {tuple(r) for r in G.reachable(short, starts).collect()} == want
    probes = spark.createDataFrame([(i, f"n{i % 12}", f"n{i * 7 % 12}") for i in range(200)] + [(900, None, "n1"), (901, "x", "n1"), (902, "n1", None)], "id int, src string, dst string")
    linked = {i for i in range(200) if distances(i % 12).get(i * 7 % 12)}
    got = {r["id"]: r["found"] for r in G.reaches(short, probes).collect()}
    assert len(got) == 203 and {i for i, found in got.items() if found} == linked


def test_sixty_four_bits_are_all_used(spark):
    starts = [f"s{i}" for i in range(200)]
    edges = spark.createDataFrame([(s, "hub") for s in starts] + [("hub", "end")], "src string, dst string")
    numbered = G.numbered_starts(spark.createDataFrame([(s,) for s in starts], "start string").coalesce(1))
    levels = G.reach_levels(edges, numbered)
    assert len(levels) == 3 and sum(level.filter("name = 'end'").count() for level in levels) == numbered.select("batch").distinct().count()
    got = {tuple(r) for r in G.reachable(edges, numbered.select("start")).collect()}
    assert got == {(s, n, d) for s in starts for n, d in (("hub", 1), ("end", 2))}


def test_merging(spark):
    old = spark.createDataFrame([("a", "b", "1"), ("a", "c", "1")], "src string, dst string, props string")
    new = spark.createDataFrame([("a", "b", "2"), ("x", "y", "2")], "src string, dst string, props string")
    assert {tuple(r) for r in G.merge_edges(old, new).collect()} == {("a", "b", "2"), ("a", "c", "1"), ("x", "y", "2")}
    nodes = G.merge_nodes(spark.createDataFrame([("a", 1)], "name string, v int"), spark.createDataFrame([("a", 2), ("b", 2)], "name string, v int"), "name")
    assert {tuple(r) for r in nodes.collect()} == {("a", 1), ("b", 2)}


def test_names_with_the_same_letters_stay_apart(spark):
    edges = spark.createDataFrame([("a", "bc", "x", "y"), ("ab", "c", "x", "y")], "src_db string, src_table string, dst_db string, dst_table string")
    assert G.nodes(G.table_name_edges(edges)).count() == 3


def test_degrees(cyclic):
    got = {r["name"]: (r["n_in"], r["n_out"], r["kind"]) for r in G.degrees(cyclic.distinct()).collect()}
    assert got == {"a": (1, 1, "inner"), "b": (1, 2, "inner"), "c": (1, 1, "inner"), "d": (1, 0, "leaf")}
