"""The near-duplicates stage of the pipeline against all pairs."""
import random

import numpy as np
import pytest
from conftest import prose

import corpus_pipeline
from tracewell.llm import jaccard


def near_rows():
    """Families of near copies around the threshold, as 30 of 300 words differ in some places or others."""
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = prose(rng, 300).split()
        for _ in range(6):
            words = list(base)
            for at in rng.sample(range(300), rng.choice([1, 3, 6, 8])):
                words[at] = "changed" + str(rng.random())
            rows.append((len(rows), " ".join(words)))
    return rows


def brute_roots(rows):
    sets = [set(jaccard.shingles_of(t or "").tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(rows))]


@pytest.mark.parametrize("crowd", [1, 8, 100])
def test_components_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = near_rows()
    want = {frozenset(i for i, r in enumerate(brute_roots(rows)) if r == top) for top in set(brute_roots(rows))}
    found = {}
    for r in jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.root, set()).add(r.id)
    assert {frozenset(ids) for ids in found.values()} == want


def test_stage_keeps_one_of_near_copies(spark, sf_dir):
    rows = near_rows()
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_roots(rows)))


def test_one_row_per_component(spark):
    rng = random.Random(6)
    one, two, three = prose(rng, 50), prose(rng, 60), prose(rng, 70)
    rows = [(1, one), (1, two), (2, two), (2, two), (None, three), (None, three), (None, one), (3, None), (4, " \n")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, one), (1, two), (None, three), (3, None)], key=repr)


def crowd_rows(n, changes, seed=3):
    """Near copies of one text, each changed in its own places."""
    rng = random.Random(seed)
    base = prose(rng, 300, 10**6).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(300), changes):
            words[at] = f"changed{rng.random()}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("changes", [2, 5, 7])  # similarities of some 0.88, 0.72 and 0.62
def test_compared_pairs_grow_with_a_crowd_and_not_its_square(spark, monkeypatch, changes):
    compared = []

    def counting(pairs, sets):
        compared.append(pairs.count())
        return real(pairs, sets)

    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", counting)
    seen = {}
    for n in (150, 600):
        compared.clear()
        roots = {r.id: r.root for r in jaccard.placed_rows(spark.createDataFrame(crowd_rows(n, changes), "doc_id long, text string")).collect()}
        seen[n] = sum(compared)
        if changes == 2:
            assert len(set(roots.values())) == 1
    assert seen[600] < 12 * 600 * jaccard.JURY
    assert seen[600] <= 4 * 2.2 * seen[150]


def test_crowds_with_one_first_member_share_a_jury(spark):
    """A key of 300 members, one of its odd members and one of all that come later: first members decide, keys of one go."""
    keys = spark.range(300).selectExpr("1L as key", "id as fp").unionAll(spark.range(1, 300, 2).selectExpr("2L", "id")).unionAll(spark.sql("select 3L, 7L"))
    members = jaccard.counted(keys)
    assert {(r.key, r.n) for r in members.select("key", "n").distinct().collect()} == {(1, 300), (2, 150)}
    place = {r.id: r.h for r in spark.range(300).selectExpr("id", "xxhash64(id) as h").collect()}
    all_of, odd = sorted(place, key=place.get), sorted((i for i in place if i % 2), key=place.get)
    found = {r.key: (r.centre, r.jury) for r in jaccard.juries(members).collect()}
    shared = all_of[0] == odd[0]
    assert found[1] == (all_of[0], all_of[:jaccard.JURY])
    assert found[2] == (odd[0], all_of[:jaccard.JURY] if shared else odd[:jaccard.JURY])
    same = spark.sql("select 5L as key, id as fp, 20L as n from range(20)").unionAll(spark.sql("select 6L, id, 20L from range(20)"))
    assert jaccard.juries(same).select("centre", "jury").distinct().count() == 1


def test_links_inside_a_crowd_are_found(spark):
    """Pairs of a crowd that are near each other and not near the rest."""
    rng = random.Random(7)
    rows = crowd_rows(240, 6)
    for i in range(40):
        words = rows[i][1].split()
        words[rng.randrange(300)] = "one"
        rows.append((1000 + i, " ".join(words)))
    roots = {r.id: r.root for r in jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_roots(rows)
    of = {i: want[k] for k, (i, _) in enumerate(rows)}
    missed = [i for i in range(40) if of[i] == of[1000 + i] and roots[i] != roots[1000 + i]]
    assert sum(of[i] == of[1000 + i] for i in range(40)) > 30 and len(missed) <= 1
    assert all(of[i] == of[j] for i in of for j in of if roots[i] == roots[j])


def test_bands_of_differences_grow_with_a_crowd(spark, monkeypatch):
    """A member has few centres, in however many crowded bands it is."""
    parted = []

    def counting(members, sets):
        parted.append(members.select("fp", "centre").distinct().count())
        return real(members, sets)

    real = jaccard.differences
    monkeypatch.setattr(jaccard, "differences", counting)
    seen = {}
    for n in (150, 600):
        parted.clear()
        jaccard.placed_rows(spark.createDataFrame(crowd_rows(n, 6), "doc_id long, text string")).count()
        seen[n] = sum(parted)
    assert 600 <= seen[600] < 3 * 600
    assert seen[600] < 4 * 1.5 * seen[150]


def test_members_that_changed_different_places_are_found_by_slack(spark):
    """Members far from each other link to the one that changed least, also where no hub is near them."""
    near, far = crowd_rows(1, 1, seed=8), crowd_rows(200, 5, seed=8)
    rows = far + [(1000, near[0][1])]
    roots = {r.id: r.root for r in jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_roots(rows)
    assert want.count(want[-1]) > 150
    assert [roots[i] == roots[1000] for i, _ in rows] == [top == want[-1] for top in want]


def test_simhash_variants_bring_near_texts_together(spark, monkeypatch):
    """What differs in four bits of a fingerprint is compared, without any band."""
    rng = random.Random(9)
    base = prose(rng, 2000).split()
    rows = [(0, " ".join(base)), (1, " ".join(base[:-1])), (2, " ".join(base[:1000] + ["new"] + base[1000:])), (3, prose(rng, 2000)), (4, None)]
    monkeypatch.setattr(jaccard, "counted", lambda keys: keys.selectExpr("key", "fp", "1L as n").limit(0))
    roots = {r.id: r.root for r in jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert roots[0] == roots[1] == roots[2]
    assert len({roots[0], roots[3], roots[4]}) == 3


def test_keys_of_one_component_are_not_carried_on(spark):
    keys = spark.sql("select * from values (1L, 5L, 5L), (1L, 6L, 5L), (2L, 5L, 5L), (2L, 7L, 7L), (3L, 9L, 9L) as t(key, fp, root)")
    rows = jaccard.counted(keys).collect()
    assert {(r.key, r.fp, r.n) for r in rows} == {(2, 5, 2), (2, 7, 2)}
    assert len({r.first for r in rows}) == 1 and rows[0].first in (5, 7)


def test_pairs_are_compared_one_at_a_time(spark):
    """No batch of whole sets goes to Python; the bound itself is a link."""
    sets = {1: list(range(90)), 2: list(range(10, 100)), 3: list(range(11, 101)), 4: list(range(80)), 5: list(range(64)), 6: [7], 7: [7]}
    frame = spark.createDataFrame([(k, v) for k, v in sets.items()], "fp long, hashes array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a > b], "a long, b long")
    found = jaccard.verified(pairs, frame)
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for a in sets for b in sets if a > b and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    assert {(r.a, r.b) for r in found.collect()} == want and {(2, 1), (5, 4), (7, 6)} <= want and (3, 1) not in want


def test_components_grow_by_new_links(spark):
    old, new = [(2, 1), (3, 2), (9, 8), (12, 11)], [(9, 3), (21, 20), (20, 12), (5, 4), (3, 1)]
    roots = jaccard.components(spark.createDataFrame(old, "a long, b long"))
    found = jaccard.merged(roots, spark.createDataFrame(new, "a long, b long"))
    want = jaccard.components(spark.createDataFrame(old + new, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_joins_by_key_grow_with_a_crowd_and_touch_its_rows_twice(spark, monkeypatch):
    """Rows of a band are joined when they are counted and, once at most, for their centre; a jury has a row per centre."""
    seen = {"counted": 0, "juries": 0}
    for name in seen:
        def counting(frame, name=name, real=getattr(jaccard, name)):
            out = real(frame)
            seen[name] += out.count()
            return out

        monkeypatch.setattr(jaccard, name, counting)
    voted, real = [], jaccard.centres
    monkeypatch.setattr(jaccard, "centres", lambda members, sets: (voted.append((members.count(), members.select("fp", "centre").distinct().count())), real(members, sets))[1])
    jaccard.placed_rows(spark.createDataFrame(crowd_rows(300, 6), "doc_id long, text string")).count()
    assert voted and all(rows == entries for rows, entries in voted)
    assert seen["juries"] < seen["counted"] < 3 * 300 * jaccard.BANDS


def test_members_of_an_open_crowd_all_stay(spark, monkeypatch):
    """Members of a crowded band of differences that are not connected in the end meet under one centre on the next level."""
    rng = random.Random(11)
    base = prose(rng, 100, 10**6).split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(100), 7):
            words[at] = f"changed{rng.random()}"
        rows.append((i, " ".join(words)))
    for name in ("CROWD", "WIDE"):
        monkeypatch.setattr(jaccard, name, 3, raising=False)
    monkeypatch.setattr(jaccard, "LEVELS", 3)
    keys, placed, real, parting = [], [], jaccard.counted, jaccard.differences
    monkeypatch.setattr(jaccard, "counted", lambda frame: (out := real(frame), keys.append(out.select("key", "fp").collect()))[0])
    monkeypatch.setattr(jaccard, "differences", lambda members, sets: (placed.append({(r.fp, r.centre) for r in members.select("fp", "centre").collect()}), parting(members, sets))[1])
    roots = {r.fp: r.root for r in jaccard.placed_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    checked = 0
    for found, stayed in zip(keys[1:], placed[1:]):
        centres, members = {}, {}
        for fp, centre in stayed:
            centres.setdefault(fp, set()).add(centre)
        for r in found:
            members.setdefault(r.key, []).append(r.fp)
        for fps in (fps for fps in members.values() if len(fps) > 3):
            apart = [(a, b) for a in fps for b in fps if a < b and roots[a] != roots[b]]
            assert all(centres.get(a, set()) & centres.get(b, set()) for a, b in apart)
            checked += len(apart)
    assert checked > 100


def test_pairs_of_a_band_are_dropped_only_where_they_cannot_be_linked(spark):
    rng = random.Random(12)
    centre, rows, sets = set(range(300)), [], {}
    for fp in range(90):
        group = random.Random(fp // 3)
        common = set(group.sample(range(300), 60)) | {1000 * (1 + fp // 3) + i for i in range(40)}
        left = common ^ set(rng.sample(range(300), rng.choice([2, 8, 20])))
        sets[fp] = centre ^ left
        rows.append((7, fp, fp, len(sets[fp]) - jaccard.FAR * len(left), len(left), jaccard.marks_of(np.array(sorted(left), np.uint64)).tolist()))
    few = spark.createDataFrame(rows, "key long, fp long, root long, slack long, far int, marks array<long>")
    found = {(r.a, r.b) for r in jaccard.paired(few).collect()}
    linked = {(a, b) for a in sets for b in sets if a > b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(linked) > 20 and linked <= found and len(found) < 90 * 89 / 8
