"""Spans: places of very many matches, in time that follows their number, and context spans against a plain version."""
import random
import time
from collections import Counter

import brute
import pytest
from conftest import prose
from pyspark.sql import functions as F

from tracewell.llm import pii, secrets, spans
from tracewell.llm.common import SPACES


def test_places_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 3)
    rng = random.Random(2)
    texts = ["", "x", "xx", "ax", "x" * 9] + ["".join(rng.choice("xab ") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", spans.hits(F.col("text"), "x+", before=True).alias("found")).collect()
    import re

    for r in rows:
        found, last = [], 0
        for m in re.finditer("x+", r.text):
            words = r.text[last:m.start()].split()
            found.append((m.start(), m.end(), m.group(), words[-1] if words else ""))
            last = m.end()
        assert [tuple(h) for h in r.found] == found


@pytest.mark.parametrize("scan", [lambda d: secrets.digests(secrets.scan_all(d)), lambda d: pii.digests(pii.scan(d))])
def test_time_follows_the_number_of_matches(spark, scan):
    """One text with 40 times the matches takes no more than some 40 times as long, which a quadratic sum would exceed by far."""
    def text(n):
        return " ".join(f"token=abcdef{i} u{i}@h.org 10.0.0.{i % 256}" for i in range(n))

    def seconds(n):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        start = time.perf_counter()
        row = scan(docs).first()
        assert max(row[c] for c in row.__fields__ if c.startswith("n_")) == n
        return time.perf_counter() - start

    seconds(100)
    few, many = seconds(5_000), seconds(200_000)
    assert many < 40 * 1.5 * few + 10


def context_spans(rows):
    """Plain version of the bootstrapped extraction: words with a digit or @, each with the word before it."""
    import re

    words = re.compile(f"[^{SPACES}]+")
    mentions = []
    for i, text in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute.personal_spans(text or "").split(",") if s]
        before = ""
        for m in words.finditer(text or ""):
            if re.search("[0-9@]", m.group()):
                seed = any(a < m.end() and b > m.start() for a, b in base)
                mentions.append((i, m.start(), m.end(), m.group().lower(), before.lower(), seed))
            before = m.group()
    mentions = [m for m in mentions if m[4]]
    n, seed = Counter((m[4], m[3]) for m in mentions), {}
    for m in mentions:
        seed[m[4], m[3]] = seed.get((m[4], m[3]), False) or m[5]
    belief = {e: float(seed[e]) for e in n}
    for _ in range(pii.ROUNDS):
        rated = {}
        for p in {p for p, _ in n}:
            own = [e for e in n if e[0] == p]
            rated[p] = (sum(n[e] * belief[e] for e in own) / (sum(n[e] for e in own) + 1), sum(seed[e] for e in own))
        reach = {}
        for p, x in n:
            if rated[p][1] >= pii.SEEDS:
                reach[x] = max(reach.get(x, 0.0), rated[p][0])
        belief = {e: 1.0 if seed[e] else reach.get(e[1], 0.0) for e in n}
    good = {p for p, (confidence, seeds) in rated.items() if confidence >= pii.GOOD and seeds >= pii.SEEDS}
    return {i: ",".join(f"context:{a}:{b}" for _, a, b in sorted({(j, a, b) for j, a, b, _, p, s in mentions if j == i and p in good and not s})) for i, _ in rows}


def test_context_spans_equal_plain(spark):
    rng = random.Random(3)
    labels = ["mailbox", "id2:", "call", "l" * 90, "x9"]
    rows = []
    for i in range(120):
        label = rng.choice(labels)
        value = rng.choice([f"user{i}@host.example.org", f"10.0.{i}.7", f"user-{i % 7}@localhost", f"v{i}", f"+1 555 010 {1000 + i}"])
        rows.append((i, f"{prose(rng, 3)} {label}\t{value} {prose(rng, 2)}"))
    rows += [(200, "id2: a1 b2 id2: c3@d"), (201, None), (202, "7 first"), (203, f"{'l' * 90} user-1@localhost \n mailbox\n9")]
    got = {r.doc_id: ",".join(s for s in r.spans.split(",") if s.startswith("context")) for r in pii.digests(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == context_spans(rows)
    assert sum(map(bool, got.values())) > 5
