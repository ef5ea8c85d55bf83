"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base kinds are e-mail, IP, payment card and telephone numbers. They are also the
seeds of a pattern-instance graph: a mention is a run without white space that
holds a digit or an @; its pattern is the word before it, its instance the run
itself. Rounds of scoring follow, over counts of the whole corpus: a pattern is
as good as the share of its mentions that are known instances, an instance as
good as its patterns make it, where seeds stay certain. Patterns that are good
and rest on several different seeds mark their other mentions as ``context``
spans.

Everything is DataFrame functions. Texts are read once and not moved; what is
joined are counted edges. A pattern with very many mentions is summed per task.

Patterns are written so that no text makes them slow: a run is tried from its
first character only (or where the last match ended), and repeats give nothing
back.

Null texts are empty and have no spans. Repeated rows get the same spans, null ids
are kept, other columns left out; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import SPACES, let, texts
from tracewell.llm.spans import SPAN, counted, hits, listed, of_kinds, spans
from tracewell.operators.skew import lookup_join
from tracewell.storage import cut, keep

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MENTION = rf"(?<![^{SPACES}])[^{SPACES}0-9@]*+[0-9@][^{SPACES}]*+"
KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
ROUNDS = 3
GOOD = 0.8  # confidence from which a pattern finds new mentions
SALTS = 8
SEEDS = 3  # different seed instances such a pattern rests on


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def is_card(hit: Column) -> Column:
    number = digits(hit)
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds of a text."""
    email = F.when(F.contains(text, F.lit("@")), hits(text, EMAIL)).otherwise(F.array())
    ip = F.filter(hits(text, IP), lambda h: h["hit"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    card = F.filter(hits(text, CARD), lambda h: is_card(h["hit"]))
    phone = F.filter(hits(text, PHONE), lambda h: F.length(digits(h["hit"])).between(9, 15))
    return F.concat(*(spans(found, kind, rank) for rank, (found, kind) in enumerate(zip((email, ip, card, phone), KINDS))))


def mentions(text: Column) -> Column:
    """Mentions with the word before each, whatever it holds, lower-cased; empty where the text's start stands before."""
    def with_pattern(found: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            earlier = F.when(h["before"] != "", h["before"]).when(i > 0, F.get(found, i - 1)["hit"]).otherwise("")
            return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lower(h["hit"]).alias("instance"), F.lower(earlier).alias("pattern"))

        return F.transform(found, one)

    return let(hits(text, MENTION, before=True), with_pattern)


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, base, mentions) of every row; ``tag`` tells rows with one id and different texts apart."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return rows.select("doc_id", "tag", base_spans(F.col("text")).alias("base"), mentions(F.col("text")).alias("mentions"))


def score(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence, seeds) of ``edges`` (pattern, instance, n, seed)."""
    known = edges.withColumn("belief", F.col("seed").cast("double"))
    for _ in range(rounds):
        rated = known.groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("belief")) / (F.sum("n") + 1)).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        copies = rated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        dealt = edges.withColumn("_salt", F.pmod(F.xxhash64("instance"), F.lit(SALTS)))  # a frequent word stands before very many
        reach = dealt.join(copies, ["pattern", "_salt"]).groupBy("instance").agg(F.max(F.when(F.col("seeds") >= SEEDS, F.col("confidence"))).alias("reach"))
        known = cut(edges.join(reach, "instance").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reach", F.lit(0.0)))).drop("reach"))
    return rated


def seen_mentions(found: DataFrame) -> DataFrame:
    """(doc_id, tag, start, end, instance, pattern, seed): every mention of ``places`` rows, a seed where a base span overlaps it.

    Mentions and base spans of a document are brought into one order: the furthest end of the spans that begin no later
    overlaps a mention, or the next span that begins inside it does.
    """
    rows = found.filter(F.size("mentions") > 0)
    base = rows.select("doc_id", "tag", F.explode("base").alias("s")).select(
        "doc_id", "tag", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit("").alias("instance"), F.lit("").alias("pattern"), F.lit(0).alias("asks"))
    asked = rows.select("doc_id", "tag", F.explode("mentions").alias("m")).select("doc_id", "tag", "m.*", F.lit(1).alias("asks"))
    own = Window.partitionBy("doc_id", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = F.max(F.when(F.col("asks") == 0, F.col("end"))).over(own.orderBy("start", "asks"))
    nearest = F.min(F.when(F.col("asks") == 0, F.col("start"))).over(own.orderBy(F.col("start").desc(), F.col("asks").desc()))
    both = base.unionByName(asked).withColumn("_furthest", furthest).withColumn("_nearest", nearest)
    seed = F.coalesce(F.col("_furthest") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_nearest") < F.col("end"), F.lit(False))
    return both.filter("asks = 1").select("doc_id", "tag", "start", "end", "instance", "pattern", seed.alias("seed"))


def discovered(found: DataFrame) -> DataFrame:
    """(doc_id, tag, more): context spans of ``places`` rows that have any."""
    seen = keep(seen_mentions(found).filter("pattern <> ''"))
    edges = cut(seen.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    good = cut(score(edges).filter((F.col("confidence") >= GOOD) & (F.col("seeds") >= SEEDS)).select("pattern"))
    new = lookup_join(seen.filter("NOT seed"), good, ["pattern"], "left_semi").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(FOUND).alias("kind"))
    return new.groupBy("doc_id", "tag").agg(F.collect_list(span).cast(SPAN).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): base and context spans of every row."""
    found = keep(places(docs))
    more = discovered(found).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "more")
    return found.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc_id", F.concat("base", F.coalesce("more", F.array().cast(SPAN))).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    base = of_kinds(F.col("found"), list(KINDS))
    return found.select(
        "doc_id", *(counted(F.col("found"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
