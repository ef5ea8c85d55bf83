"""Collocations against a plain count of all phrases, with budgets that force every way a prefix can be extended."""
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, size int, a long, grp int, n string"


def plain(rows, least, top):
    counts = {}
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 5):
                own.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in often.items():
            longer = [c for q, c in often.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= 80 * a for c in longer):
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "a", "\x01", "é", "x y", "\U0001f600", "sea"]
    rows = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r", " \x0b "]) for _ in range(rng.randrange(30)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [("New York City Hall is open", "en")] * 40 + [("the the the the the the " * 50, "en"), ("alone", "xx"), (None, "en"), ("", None), (" \t\n", "fr"), ("z" * 20_000 + " of", "de")]
    return rows


@pytest.mark.parametrize("chunk, group", [(16 << 20, 16 << 20), (2_000, 16 << 20), (2_000, 40), (300, 1_500)])
def test_equals_plain(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(phrases, "GROUP_BYTES", group)
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, "n") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)
    got = phrases.collocations(docs, least=5, top=25).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, 5, 25))
    assert len(got) > 40


def test_heavy_prefixes_are_all_that_exceed_the_limit(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    rows = corpus(4)
    docs = spark.createDataFrame([(t or "", lang or "und") for t, lang in rows], "text string, lang string").repartition(6)
    groups = 12
    heavy = set(phrases.heavy_prefixes(docs, groups).tolist())
    batch = docs.select("text", "lang").toArrow().to_batches()
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1 << 30)
    (whole,) = phrases.chunks(iter(batch))
    total, hashes = whole.counts.sum(), whole.hashes(3)
    for depth in (1, 2, 3):
        first, counts = whole.prefixes(depth)
        for h, n in zip(hashes[depth - 1][first].tolist(), counts.tolist()):
            assert h in heavy or n <= total / (groups * phrases.HEAVY)
            assert h not in heavy or n >= total / (groups * phrases.HEAVY) / 2


def test_nothing_frequent(spark, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")).collect() == []
    found = phrases.nodes(spark.createDataFrame([("b a b. a B", "en")], "text string, lang string"), 1)
    assert {(r.phrase, r.size, r.a) for r in found.filter(F.col("size") > 0).collect()} == {("a", 1, 2), ("b", 1, 3), ("b a", 2, 1), ("a b", 2, 2), ("b a b", 3, 1)}
