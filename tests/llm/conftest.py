import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that operators make themselves, here as columns of the input
CLASHING = "id long, tag long, fp long, ids string, words string, n long, found string, marks string, votes int, kept string, line string, decoded string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}x" for _ in range(n))


def edge_rows():
    """Nulls, empty and very long texts, ties, repeats, copies and near copies, unusual white space and signs."""
    rng = random.Random(11)
    base, other = prose(rng, 300), prose(rng, 250)
    long_line = prose(rng, 60)
    rows = [
        (10, base), (11, base), (12, base.replace(" ", "  ", 3)), (13, base + " tail"), (5, "head " + base),
        (20, other), (20, other), (20, other[:900]), (None, other), (None, None), (None, "nobody " + prose(rng, 80)),
        (1, None), (2, ""), (3, " \t\n \x0b\x0c\r"), (4, "one"), (6, "two words"), (7, "  \u0085 wide"), (8, "\x00\x01 zero � \U0001f600 éé"),
        (30, f"first line here\n{long_line}\nlast"), (31, f"another\n{long_line}\nend"), (32, f"\n\n{long_line}\n"), (33, "\n".join([long_line] * 4)),
        (40, "a" * 30_000), (41, prose(rng, 9_000)), (42, "x1" * 4_000 + " \n" * 500), (43, "\n" * 3_000),
        (50, "password = hunter22! token:'abc' secret=token=abcdefgh api_key: \"ZZZZZZ\" PassWD:a"), (51, "AKIA" + "A" * 16 + " AKIAB AKIAAKIA" + "7" * 12 + " " + "0a" * 12),
        (52, "mail a.b@c-d.example.org, x@y z@w.. q@r.s_t@u.v 1.2.3.4 256.1.1.1 001.02.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112"),
        (53, "+1 (555) 010-9999 call +44 20 7946 0958x +12345 + 12345678901 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"),
        (54, "<|endoftext|> in <|endoftext|>text it's we'll 'S   spaces  \n\n tabs\t\tend "), (55, "a.a." * 3_000 + "@"), (56, "5" * 20_000), (57, "a@" * 3_000),
        (60, "</s>[INST] \\ <s> <<SYS>>\n [ROLE]"), (9_000_000_000, "far " + base[:700]),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t), *([k, None, 7, "x", "y", k, None, "m", 1, "no", "", None]))
            for k, (i, t) in enumerate(edge_rows())]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, {CLASHING}").repartition(5)


@pytest.fixture(scope="session")
def plain_rows():
    return edge_rows()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
