"""Quality rules as weak supervision.

Every rule looks at counts of a text and votes good, bad or abstains. How far a
rule can be trusted is not set by hand: expectation-maximisation over the votes
of the whole corpus estimates, for each rule, how often it votes which way on
good and on bad texts, and from these the probability that a text is good. Texts
are kept from a posterior of one half on. Hard limits (``base_failed``) reject
regardless of the vote.

Votes are counted in Spark per combination of votes; there are at most
3 ** rules of them whatever the corpus holds, so the estimation works on that
table and is exact for all rows.

A null text is empty and fails the hard limits. Lines are split at \\n only,
words at ASCII white space. Repeated rows vote each for itself. An empty table
has no votes and gives an empty result.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField

from tracewell.llm.common import texts, with_columns
from tracewell.storage import keep

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
IS_WHITE, IS_SYMBOL = (np.isin(np.arange(256), list(signs)) for signs in (WHITE, SYMBOLS.encode()))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_distinct", "n_letters", "n_symbol_ends")
MIN_WORDS = 50
PRIOR_GOOD = 0.8
KEEP_FROM = 0.5
START_GOOD = 0.95
START_PER_BAD = 0.2
ROUNDS = 200
GAP = 1e-9


def repeated_words(ids: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more, each word once."""
    if len(ids) < 4:
        return 0
    size = np.int64(ids.max()) + 1
    pair = ids[:-2] * size + ids[1:-1]
    if size < 1 << 20:
        codes = pair * size + ids[2:]
    else:  # number the pairs first, so that a code fits 64 bits
        codes = np.unique(pair, return_inverse=True)[1] * size + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The counts that rules look at, in the order of COUNTS."""
    raw = text.encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = raw.split(b"\n")
    filled = [line for line in lines if line.strip(WHITE)]
    signs = np.frombuffer(raw, np.uint8)
    known = np.bincount(signs, minlength=256)
    upper, lower = int(known[65:91].sum()), int(known[97:123].sum())
    return (
        len(words),
        len(text) - int(known[list(WHITE)].sum()),
        int(known[[ord(c) for c in SYMBOLS]].sum()),
        len(filled) - len(set(filled)),
        repeated_words(ids),
        len(filled),
        upper,
        lower,
        raw.count(b"!!"),
        len(seen),
        upper + lower + len(text) - int(known[:128].sum()),
        int((IS_SYMBOL[signs[:-1]] & IS_WHITE[signs[1:]]).sum()) + int(len(signs) > 0 and IS_SYMBOL[signs[-1]]),
    )


def votes_of(counts: tuple[int, ...]) -> tuple[int, ...]:
    """One vote per rule: 1 good, -1 bad, 0 abstains."""
    n, chars, symbols, dup_lines, repeats, lines, upper, lower, shouts, distinct, letters, symbol_ends = counts

    def vote(good: bool, bad: bool) -> int:
        return 1 if good else -1 if bad else 0

    return (
        vote(n >= 2 * MIN_WORDS, n < MIN_WORDS),
        vote(2 * n <= chars <= 9 * n, chars > 12 * n or chars < 2 * n),
        vote(50 * symbols <= n, 10 * symbols > n),
        vote(5 * dup_lines < lines and lines > 1, 2 * dup_lines > lines),
        vote(10 * repeats <= n, 10 * repeats > 3 * n),
        vote(4 * upper < lower, upper > lower),
        vote(20 * shouts < n and lower > 0, 5 * shouts > n),
        vote(5 * distinct >= 2 * n and n >= MIN_WORDS, 4 * distinct < n),
        vote(100 * letters > 90 * chars, 100 * letters < 80 * chars),
        vote(50 * symbol_ends <= n, 5 * symbol_ends > n),
    )


RULES = 10


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]


def estimate(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for every combination of votes, by expectation-maximisation.

    For each class a rule has a probability of every vote, abstaining included.
    Start: a bad vote is rarer than a good one and says more, so each lowers the
    chance of good by a factor. Smoothing keeps a rule that never votes one way
    from deciding alone.
    """
    if not patterns:
        return {}
    votes = np.array(list(patterns), np.int64) + 1
    weight = np.array(list(patterns.values()), float)
    good = START_GOOD * START_PER_BAD ** (votes == 0).sum(axis=1)
    prior, before = PRIOR_GOOD, -math.inf
    for _ in range(ROUNDS):
        like = np.zeros((2, len(weight)))
        for side, share in enumerate((1 - good, good)):
            mass = weight * share
            for rule in range(votes.shape[1]):
                seen = np.bincount(votes[:, rule], mass, minlength=3) + 1.0
                like[side] += np.log(seen / seen.sum())[votes[:, rule]]
        prior = min(max(float((weight * good).sum() / weight.sum()), 0.01), 0.99)
        like += np.log([[1 - prior], [prior]])
        top = like.max(axis=0)
        total = top + np.log(np.exp(like - top).sum(axis=0))
        good = np.exp(like[1] - total)
        fit = float((weight * total).sum())
        if abs(fit - before) <= GAP * abs(fit):
            break
        before = fit
    return dict(zip(patterns, good.tolist()))


def coded(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def decoded(code: int) -> tuple[int, ...]:
    return tuple(code // 3 ** (RULES - 1 - i) % 3 - 1 for i in range(RULES))


def posteriors(voted: DataFrame, column: str = "votes") -> dict[int, float]:
    """Posterior per vote code; counts of all rows, at most 3 ** RULES of them, come to the driver."""
    counted = {decoded(r[0]): r[1] for r in voted.groupBy(column).count().collect()}
    return {coded(votes): p for votes, p in estimate(counted).items()}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, votes code, base_failed) of every row."""

    def compute(batch: pa.RecordBatch) -> list:
        found = [counts_of(t) for t in batch.column("text").to_pylist()]
        return [*(zip(*found) if found else [()] * len(COUNTS)), [coded(votes_of(c)) for c in found], [base_failed(c) for c in found]]

    fields = [*(StructField(c, LongType()) for c in COUNTS), StructField("votes", IntegerType()), StructField("base_failed", BooleanType())]
    return with_columns(texts(docs), fields, compute).drop("text")


def judged(docs: DataFrame) -> DataFrame:
    """Every row's counts, hard limits, posterior (``p_good``) and verdict (``kept``)."""
    voted = keep(features(docs))
    found = posteriors(voted)
    table = docs.sparkSession.createDataFrame(list(found.items()), "votes int, p_good double")  # at most 3 ** RULES rows
    return voted.join(F.broadcast(table), "votes").withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)).drop("votes")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Counts are made twice instead of moving texts."""
    votes = features(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    good = {code for code, p in posteriors(votes).items() if p >= KEEP_FROM}

    def compute(batch: pa.RecordBatch) -> list:
        found = [counts_of(t or "") for t in batch.column(text_col).to_pylist()]
        return [[not base_failed(c) and coded(votes_of(c)) in good for c in found]]

    return with_columns(docs, [StructField("_llm_kept", BooleanType())], compute).filter("_llm_kept").drop("_llm_kept")
