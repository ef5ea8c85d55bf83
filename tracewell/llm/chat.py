"""Chat formatting over a prefix tree of conversations.

Template: ``<s>[INST] `` text `` [/INST]`` for the user, `` `` text `` </s>`` for the
assistant, ``<<SYS>>\\n`` text ``\\n<</SYS>>\\n\\n`` for the system, and
``[ROLE] `` role ``:`` text `` [/ROLE]`` for any other role. A backslash, and the
first sign of a control string inside a text or role, are escaped, so a text can
hold the template's own marks and is read back unchanged.

Conversations whose first turns are equal share those turns. A node of the tree
is the chain digest of all turns up to it; the conversation with the smallest id
through a node owns it, and what a conversation owns is the end of its own turns.
So the depth-first output has one segment per conversation, in the order of
``path``: what it does not share with a smaller one, with the position where it
starts and, as attention, the (owner, start, end) ranges of the ancestors it
continues. No tree is gathered in one place: rows of a conversation stream through
a task in order, and the largest state is the digest and the running length.

Null texts and roles are empty. Rows of one conversation go by turn, then role, then
text, nulls first; repeated rows are turns of their own. A null conv_id is a
conversation. Other columns are left out; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tracewell.llm.common import with_columns
from tracewell.operators.skew import lookup_join
from tracewell.storage import keep

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")  # of the template
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER = ("[ROLE] ", " [/ROLE]")
ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n|\[ROLE\] (?P<name>(?:[^\\]|\\[^:])*+)\\:(?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL)
NODES = "conv_id long, depth int, node string, parent string, role string, formatted string, position_start long, position_end long"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0] if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> str:
    """One turn with its marks. ``\\:`` parts another role from its text: no escape in escaped text is of a colon."""
    if role in MARKS:
        before, after = MARKS[role]
        return before + escape(text) + after
    return OTHER[0] + escape(role) + "\\:" + escape(text) + OTHER[1]


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn, start and end of its escaped text in the formatted one."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        kind = found.lastgroup
        role = unescape(found["name"]) if kind == "other" else kind
        yield role, unescape(found[kind]), found.start(kind), found.end(kind)
        at = found.end()


def ordered(turns: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def nodes(turns: DataFrame) -> DataFrame:
    """A row per turn with the tree node it is: digests of its path, formatted text and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, parent, position = object(), 0, "", 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != conv:
                    conv, depth, parent, position = conv_id, 0, "", 0
                formatted = turn_text(role, text)
                node = hashlib.sha256(f"{parent}\n{formatted}".encode()).hexdigest()[:32]
                rows.append((conv_id, depth, node, parent, role, formatted, position, position + len(formatted)))
                parent, depth, position = node, depth + 1, position + len(formatted)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*((n, kinds[t]) for n, t in (f.split() for f in NODES.split(", "))))
    return ordered(turns).mapInArrow(run, NODES)


def tree(turns: DataFrame) -> DataFrame:
    """Every row of ``nodes`` with the node's owner, the smallest conversation through it (null last)."""
    rows = nodes(turns)
    owners = rows.groupBy("node").agg(F.min("conv_id").alias("owner"))
    return lookup_join(rows, owners, ["node"])  # a first turn may belong to very many


def segments(placed: DataFrame) -> DataFrame:
    """The output: what each conversation owns, once, depth first by ``path``.

    (conv_id, path, position_start, text, n_turns, attention): position ids run
    from ``position_start``; ``attention`` lists the ancestors' ranges as (owner,
    start, end), nearest last, beside which a token sees its own segment up to
    itself. A conversation that owns nothing has an empty text and attends to all
    of its owners' ranges.
    """
    own = F.col("owner").eqNullSafe(F.col("conv_id"))
    parts = placed.groupBy("conv_id", "owner").agg(
        F.min("depth").alias("depth"), F.min("position_start").alias("start"), F.max("position_end").alias("end"),
        F.min(F.struct("depth", "node")).getField("node").alias("node"), F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("depth", "formatted")))), lambda t: t["formatted"]), "").alias("text"))
    own_part = F.struct("start", "text", "n_turns")
    return parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("depth", "node", "owner", "start", "end"))).alias("chain"),
        F.max(F.when(own, own_part)).alias("own")).select(
        "conv_id", F.array_join(F.transform("chain", lambda p: p["node"]), "/").alias("path"),
        F.coalesce("own.start", F.try_element_at("chain", F.lit(-1))["end"]).alias("position_start"),
        F.coalesce("own.text", F.lit("")).alias("text"), F.coalesce("own.n_turns", F.lit(0)).alias("n_turns"),
        F.transform(F.filter("chain", lambda p: ~p["owner"].eqNullSafe(F.col("conv_id"))),
                    lambda p: F.struct(p["owner"].alias("owner"), p["start"].alias("start"), p["end"].alias("end"))).alias("attention"))


def write(turns: DataFrame) -> DataFrame:
    """The formatted output as a kept table."""
    return keep(segments(tree(turns)))


def restored(output: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation put together again from its own segment and the ranges it attends to."""
    wanted = output.select("conv_id", F.explode("attention").alias("a")).select("conv_id", "a.owner", "a.start", "a.end")
    held = output.select(F.col("conv_id").alias("_holder"), F.col("position_start").alias("_from"), F.col("text").alias("_text"))
    shared = wanted.join(held, F.col("owner").eqNullSafe(F.col("_holder"))).select(
        "conv_id", "start", F.substr("_text", (F.col("start") - F.col("_from") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("part"))
    parts = shared.unionAll(output.select("conv_id", F.col("position_start").alias("start"), F.col("text").alias("part")).filter("part <> ''"))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p["part"]), "").alias("formatted"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what is read back out of each formatted conversation."""

    def compute(batch: pa.RecordBatch) -> list:
        found = []
        for text in batch.column("formatted").to_pylist():
            turns, learned = hashlib.sha256(), hashlib.sha256()
            n = chars = 0
            for role, content, start, end in read_turns(text):
                n += 1
                turns.update(f"{role}\n{content}\n".encode())
                if role == "assistant":  # the loss mask covers [start, end) of the formatted text
                    under = unescape(text[start:end])
                    learned.update(under.encode())
                    chars += len(under)
            found.append((n, turns.hexdigest(), chars, learned.hexdigest(), len(text)))
        return list(zip(*found)) if found else [[]] * 5

    fields = [StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
              StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]
    return with_columns(formatted, fields, compute).drop("formatted")
