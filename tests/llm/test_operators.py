"""Every operator against its plain version, on texts that are awkward on purpose, and on empty tables."""
import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import bpe, chat, decontaminate, licenses, lines, pii, quality, secrets, simhash, suffixes
from tracewell.llm.license_templates import TEMPLATES
from tracewell.llm.queries import tokenizer_file


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# 1: BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_bpe_equals_library(edge_docs, plain_rows, library):
    want = Counter()
    for row_id, text in plain_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[row_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert rows_of(bpe.round_trip(edge_docs, tokenizer_file()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_uses_one_worker_a_task(spark, edge_docs, sf_dir):
    path = tokenizer_file()
    both = bpe.encode_and_decode(edge_docs, path, keep_text=True)
    assert rows_of(both.withColumn("ids", F.col("ids").cast("string")), *both.columns) == rows_of(
        bpe.decode(bpe.encode(edge_docs, path, keep_text=True), path).withColumn("ids", F.col("ids").cast("string")), *both.columns)
    for df in (corpus_pipeline.tokens(spark, edge_docs, sf_dir), bpe.round_trip(edge_docs, path)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_bpe_streams_long_pieces(library):
    own = bpe.tokenizer(tokenizer_file())
    rng = random.Random(2)
    for signs in ("ab", "thein", "aeiounst", "0123456789", "=-_"):
        text = "".join(rng.choice(signs) for _ in range(30_000))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < own.lookahead < 1024


def test_bpe_ascii_texts_equal_library(library):
    own = bpe.tokenizer(tokenizer_file())
    rng = random.Random(3)
    for signs in ("".join(map(chr, range(128))), "\x1c\x1d\x1e\x1f \t\n\x0b\x0c\rab1", "'stdmrevl ", "a1-'  \n"):
        for n in (1, 2, 3, 60) * 50:
            text = "".join(rng.choice(signs) for _ in range(n))
            assert own.ascii_pieces.findall(text) == own.pieces.findall(text)
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_lookahead_is_enough(library):
    """Tokens further than the lookahead from the end of a prefix are those of the whole."""
    own = bpe.tokenizer(tokenizer_file())
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice("thenigaos") for _ in range(3000)).encode()
        cut = rng.randrange(1500, 2500)
        whole, part = (own.merged([own.first[b] for b in t]) for t in (text, text[:cut]))
        end = 0
        for a, b in zip(whole, part):
            end += len(own.bytes_of[b])
            if end > cut - own.lookahead:
                break
            assert a == b


def test_bpe_decodes_broken_bytes(library):
    own = bpe.tokenizer(tokenizer_file())
    for ids in ([], [own.first[0xC3]], [own.first[0xE2], own.first[0x82], own.first[0x41]], [own.first[b] for b in "é😀".encode()], [50256, own.first[0xFF]]):
        assert own.decode(ids, step=1) == library.decode(ids, skip_special_tokens=False)


# 2: licences


def test_licenses(spark, edge_docs):
    assert licenses.scan(edge_docs, TEMPLATES).count() == 0
    rng = random.Random(4)
    notice = TEMPLATES[1][2]
    words = notice.split()
    changed = " ".join(w if i != 12 else "changed" for i, w in enumerate(words))
    rows = [(1, prose(rng, 37) + " " + notice + " " + prose(rng, 50)), (2, notice.upper()), (3, prose(rng, 400) + " " + changed), (4, " ".join(words[:12])),
            (5, TEMPLATES[3][2]), (5, TEMPLATES[3][2]), (None, "x " + TEMPLATES[8][2])]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES)
    got = {(r.doc_id, r.template_id) for r in found.collect()}
    assert {(1, 1), (1, 2), (2, 2), (3, 2), (5, 4), (None, 9)} <= got
    assert not any(key == 2 for doc, key in got if doc == 4)


def test_license_bands_miss_little():
    for size, smallest in ((8, 1), (8, 4), (64, 29)):
        bands = licenses.bands_for(size, smallest)
        shared = -(-smallest * 4 // 5)
        similarity = shared / (smallest + 2 * size - 4 - shared)
        assert (1 - similarity) ** bands <= licenses.MISS


# 3: substrings


def test_substrings(edge_docs, plain_rows):
    want = Counter(brute.substrings(plain_rows))
    assert rows_of(suffixes.dedup(edge_docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_substrings_of_crowds(spark, monkeypatch):
    """Grams that many documents share go window by window, in some batches and not in others."""
    monkeypatch.setattr(suffixes, "CROWD", 5)
    rng = random.Random(6)
    line = prose(rng, 14)
    rows = [(i, f"{prose(rng, 12)} {line} {prose(rng, 9)}") for i in range(60)] + [(100 + i, f"{line}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(suffixes.dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.substrings(rows))


def test_only_tied_lms_suffixes_are_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(1, 200, 20_000).astype(np.uint8)
    text[15_000:16_000] = text[2_000:3_000]
    text[9_000:9_100] = 7
    sizes, real = [], suffixes.refined
    monkeypatch.setattr(suffixes, "refined", lambda names, tied, then: (sizes.append(len(tied)), real(names, tied, then))[1])
    places = suffixes.lms_places(suffixes.classes(text))
    found = suffixes.sorted_lms(text, places, suffixes.LENGTH)
    starts = [text[p:p + suffixes.LENGTH].tobytes() for p in found]
    assert sorted(found) == places.tolist() and starts == sorted(starts)
    assert sizes[0] == len(places) and max(sizes[1:]) < len(places) / 8


def test_entries_of_a_document_are_packed_without_a_row_each():
    rng = np.random.default_rng(4)
    ids, tags, starts = rng.integers(0, 40, 500), rng.integers(0, 2, 500), np.arange(500, dtype=np.uint32)
    table = suffixes.by_document("mark", ids, tags, [starts, (starts % 7).astype(np.uint8)])
    assert table.schema == suffixes.found_batch([]).schema
    got = {(r["id"], r["tag"]): (np.frombuffer(r["starts"], np.uint32), np.frombuffer(r["counts"], np.uint8), r["grams"], r["data"]) for r in table.to_pylist()}
    assert len(got) == table.num_rows == len(set(zip(ids.tolist(), tags.tolist())))
    for (i, t), (own, counts, *rest) in got.items():
        assert sorted(own.tolist()) == starts[(ids == i) & (tags == t)].tolist() and (counts == own % 7).all() and rest == [b"", b""]
    assert suffixes.by_document("mark", ids[:0], tags[:0], [starts[:0], starts[:0]]).num_rows == 0
    grams, hashes = rng.integers(0, 300, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
    order = suffixes.in_order(grams, hashes, ids)
    rows = list(zip(grams[order], hashes[order], ids[order]))
    assert rows == sorted(rows) and sorted(order) == list(range(500))


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(60):
        text = np.tile(rng.integers(1, 2 + trial % 5, rng.integers(2, 90)), 1 + trial % 3)
        text = np.concatenate([text, [0]]).astype(np.uint8)
        array, data = suffixes.suffix_array(text, 50), text.tobytes()
        assert sorted(array) == list(range(len(text)))
        heads = [data[i:i + 50] for i in array]
        assert heads == sorted(heads)
        same = suffixes.agrees(text, array, 50)
        for x, y in zip(array, array[1:]):
            assert same[y] == (max(x, y) + 50 <= len(data) and data[x:x + 50] == data[y:y + 50])


# 4: lines


def test_lines_of_copies(spark, edge_docs, plain_rows):
    got = {(r.doc_id, r.kept_sha256): r for r in lines.digests(edge_docs).collect()}
    assert sum(rows_of(lines.digests(edge_docs), "doc_id").values()) == len(plain_rows)
    texts = dict(r for r in plain_rows if r[0] is not None)
    assert (10, brute.sha(texts[10])) in got  # the first copy stays whole
    assert got[11, brute.sha("")].n_deleted == 1
    assert (31, brute.sha("another\nend")) in got
    assert (30, brute.sha(texts[30])) in got
    assert got[1, brute.sha("")].n_lines == 0


def test_patience():
    assert lines.aligned([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert lines.aligned([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert lines.aligned([], [1]) == []
    assert lines.chain([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]
    assert lines.common_blocks([1, 2, 3, 9, 5], [0, 1, 2, 3, 5], [40, 40, 40, 1, 60], 100) == [0, 1, 2]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = lines.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_lines_every_later_block_is_in_an_earlier_document(spark):
    rng = random.Random(3)
    pool = [prose(rng, 12) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 10) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    done = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    texts = dict(rows)
    earlier = {}
    for i, text in rows:
        for line in text.split("\n"):
            earlier.setdefault(line, i)
    left = Counter()
    for r in done:
        kept = Counter(r.text.split("\n")) if r.text else Counter()
        gone = Counter(texts[r.doc_id].split("\n")) - kept
        assert all(earlier[line] < r.doc_id for line in gone)
        left.update(kept.keys())
    assert all(line in left for line in earlier)  # nothing is lost altogether
    assert sum(r._llm_deleted for r in done) > 20


# 5: chat

TURNS = "conv_id long, turn long, role string, text string, node string, owner long"


def chat_rows():
    hard = "</s>[INST] \\ok\\ [/INST]<<SYS>>\n<</SYS>>\n\n[ROLE] x\\: [/ROLE] <\\s> \\"
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"),
        (2, 0, "system", "be kind"), (2, 1, "user", "hello"), (2, 2, "assistant", "good day"), (2, 3, "user", None),
        (3, 0, "system", "be kind"), (3, 1, "user", "hello"), (3, 2, "assistant", "hi"), (4, 5, "user", hard), (4, 6, "assistant", hard), (4, 7, "tool", hard), (4, 8, hard, hard),
        (5, 0, "assistant", ""), (5, 0, "assistant", ""), (5, 0, "user", "tie"), (5, None, "user", "before"), (None, 1, None, "no one"), (6, 0, "system", "be kind"), (7, 0, "assistant", "é😀\r\n"),
    ]


def test_chat(spark):
    rows = chat_rows()
    output = chat.write(spark.createDataFrame([(*r, "n", 3) for r in rows], TURNS).repartition(4))
    got = {r.conv_id: r for r in chat.digests(chat.restored(output)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        learned = "".join(text for *_, role, text in own if role == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == brute.sha("".join(f"{role}\n{text}\n" for *_, role, text in own))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), brute.sha(learned))
        assert got[conv].formatted_chars == sum(len(chat.turn_text(role, text)) for *_, role, text in own)


def test_chat_shares_turns_once(spark):
    rows = chat_rows()
    output = chat.write(spark.createDataFrame([(*r, "n", 3) for r in rows], TURNS)).collect()
    by_conv = {r.conv_id: r for r in output}
    assert "".join(r.text for r in output).count("be kind") == 1
    assert by_conv[3].text == "" and by_conv[6].text == ""
    assert [a.owner for a in by_conv[2].attention] == [1]
    assert by_conv[2].position_start == by_conv[2].attention[0].end
    order = [r.conv_id for r in sorted(output, key=lambda r: (r.path, r.conv_id or 0))]
    assert order.index(2) > order.index(1)


def test_chat_escape():
    rng = random.Random(8)
    parts = [*chat.CONTROL, "\\", "<", "[", "s>", "a", "\n", " ", ":", "/"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROL)


# 6 and 7: spans


@pytest.mark.parametrize("scan, plain", [
    (lambda d: secrets.digests(secrets.scan_all(d)), brute.secret_spans), (lambda d: pii.digests(pii.scan(d)), brute.personal_spans)])
def test_base_spans(edge_docs, plain_rows, scan, plain):
    want = Counter((i, brute.sha(plain(t or ""))) for i, t in plain_rows)
    assert rows_of(scan(edge_docs), "doc_id", "base_sha256") == want


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "token = abcdef1"), (2, "plain"), (3, "token = abcdef1")], schema)
    secrets.scan_all(first, path).collect()
    assert secrets.read_ledger(spark, path).count() == 2  # one row per content
    second = spark.createDataFrame([(4, "token = abcdef1"), (5, "AKIA" + "B" * 16)], schema)
    got = {r.doc_id: [s.kind for s in r.found] for r in secrets.scan_all(second, path).collect()}
    assert got == {4: ["assign"], 5: ["access"]}
    assert secrets.read_ledger(spark, path).count() == 3
    newer = [r for r in secrets.RULES if r.kind != "access"] + [secrets.Rule("access", 2, "B{16}")]
    got = {r.doc_id: [(s.kind, s.start) for s in r.found] for r in secrets.scan_all(second, path, newer).collect()}
    assert got == {4: [("assign", 0)], 5: [("access", 4)]}  # of the version asked for, not of the one before
    again = [list(r.found) for r in secrets.read_ledger(spark, path).collect()]
    assert sorted(map(len, again)) == [1, 1, 5, 5, 5]  # a changed rule alone is applied to the blobs of the second call
    assert secrets.scan(first, secrets.read_ledger(spark, path)).count() == 0
    back = {r.doc_id: [(s.kind, s.start) for s in r.found] for r in secrets.scan_all(second, path).collect()}
    assert back == {4: [("assign", 0)], 5: [("access", 0)]}


def test_findings_join_back_to_all_paths(spark, tmp_path):
    """A path that held a secret once is reported after a later version without it."""
    path, schema = str(tmp_path / "ledger"), "doc_id long, text string"
    for text in ("token = abcdef1", "clean", "token = abcdef1"):
        secrets.scan_all(spark.createDataFrame([(1, text), (None, text)], schema), path).collect()
    rows = [(r.doc_id, [s.kind for s in r.found]) for r in secrets.report_all(spark, path).collect()]
    assert sorted(rows, key=repr) == sorted([(1, ["assign"]), (1, []), (None, ["assign"]), (None, [])], key=repr)


def test_scan_in_steps_equals_one_scan(spark, edge_docs):
    assert rows_of(secrets.digests(secrets.scan_in_steps(edge_docs)), "doc_id", "spans") == rows_of(secrets.digests(secrets.scan_all(edge_docs)), "doc_id", "spans")


def test_context_finds_more(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 20)} mailbox user{i}@host.example.org {prose(rng, 5)}") for i in range(30)]
    rows += [(100, "my mailbox user-77@localhost is new"), (101, "no mailbox here"), (102, "version 2.0 of it"), (103, "level 3 mailbox user-77@localhost")]
    got = {r.doc_id: r.spans for r in pii.digests(pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100] == "context:11:28"
    assert got[103].startswith("context:16:")
    assert got[101] == got[102] == ""


# 8: decontamination


def lossless(masks, size, misses, stride):
    """Whether every set of ``misses`` unequal words, some of them outside at either end, leaves a seed at every parity."""
    from itertools import combinations

    for before in range(misses + 1):
        for after in range(misses + 1 - before):
            for missed in combinations(range(before, size - after), misses - before - after):
                for parity in range(stride):
                    if not any(all(at + p not in missed for p in mask) for mask in masks
                               for at in range(before, size - after - mask[-1]) if at % stride == parity):
                        return False
    return True


def test_masks_miss_nothing():
    assert lossless(decontaminate.MASKS, 15, 3, decontaminate.STRIDE)
    assert lossless(decontaminate.MASKS, 20, 4, decontaminate.STRIDE)


def test_overlaps(spark, edge_docs, plain_rows):
    rng = random.Random(12)
    items = [(k, prose(rng, n, 9)) for k, n in enumerate((1, 4, 8, 9, 14, 15, 17, 20, 25, 40, 60))] + [(90, None), (91, ""), (92, plain_rows[0][1][:300])]
    docs = [(i, t) for i, t in plain_rows if t is None or len(t) < 5000]
    for k, text in items[:11]:
        words = text.split()
        for share in (0.0, 0.05, 0.12, 0.2, 0.3):
            changed = [w if rng.random() >= share else "zz" for w in words]
            lead = prose(rng, rng.randrange(4), 9)
            docs.append((1000 + len(docs), f"{lead} {' '.join(changed)} {prose(rng, rng.randrange(3), 9)}"))
        docs.append((1000 + len(docs), " ".join(words[2:])))
        docs.append((1000 + len(docs), " ".join(words[:-3])))
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, k, *best) for i, t in set(docs) for k, item in items if (best := brute.overlap(t, item))}
    assert {(r.doc_id, r.item_id, r.n_equal, r.at) for r in found.collect()} == want
    assert len(want) > 30


# 9: quality


def test_quality_counts(edge_docs, plain_rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((i, *(brute.quality_counts(t or "")[n] for n in names)) for i, t in plain_rows)
    got = quality.judged(edge_docs)
    assert rows_of(got, "doc_id", *names) == want
    assert got.filter("kept AND base_failed").count() == 0
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert rows_of(kept, "doc_id", "text") == Counter((i, t) for i, t in plain_rows if (i, t) in {
        (r.doc_id, r.text) for r in kept.collect()})


def test_quality_agrees_with_labels(spark):
    """Held-out accuracy: labels are never shown to the estimation."""
    folder = "/root/testdata/sf0.01"
    judged = quality.judged(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("NOT base_failed").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.97


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, 5)) < [0.95, 0.9, 0.85, 0.8, 0.75], np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns = Counter(map(tuple, votes.tolist()))
    posterior = quality.estimate(dict(patterns))
    judged = np.array([posterior[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (judged == good).mean() > 0.94
    assert quality.estimate({}) == {}
    assert all(quality.decoded(quality.coded(v)) == v for v in [(1, -1, 0, 1, 1, -1, 0, 0, 1, -1)])


# 10: near-duplicates


def test_near_duplicates(edge_docs, plain_rows):
    assert rows_of(simhash.near_duplicates(edge_docs), "doc_id", "fingerprint", "component_id") == Counter(brute.near(plain_rows))


def test_one_of_each(edge_docs, plain_rows):
    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    named = {c for _, _, c in brute.near(plain_rows)}
    assert Counter(i for i in ids if i is not None) == Counter(c for c in named if c is not None)
    assert ids.count(None) == 1


def test_links_reach_four_bits():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, 4, replace=False)]) for _ in base])
    own, other = simhash.variants(base), simhash.variants(base ^ flips)
    assert all(np.intersect1d(a, b).size for a, b in zip(own, other))


def test_forest_connects_long_runs(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_RUN", 10)
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
    roots = {}
    for found, root in simhash.forest(fps):
        assert len(found) == len(root)
        for a, b in zip(found.tolist(), root.tolist()):
            roots.setdefault(a, set()).add(b)
    assert len(simhash.run_links(np.zeros(len(fps), np.uint64), fps)[0]) >= len(fps) - 3


# Empty tables


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "some words of a benchmark item that are fifteen words long or so I do think")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for df in (
        bpe.round_trip(no_docs, tokenizer_file()), licenses.scan(no_docs, TEMPLATES), licenses.scan(no_docs, []), suffixes.dedup(no_docs), lines.digests(no_docs),
        secrets.digests(secrets.scan_all(no_docs)), pii.digests(pii.scan(no_docs)), decontaminate.overlaps(no_docs, items), decontaminate.overlaps(no_docs, none),
        quality.judged(no_docs), quality.keep_good(no_docs), simhash.near_duplicates(no_docs), simhash.one_of_each(no_docs),
        chat.digests(chat.restored(chat.write(spark.createDataFrame([], TURNS)))),
    ):
        assert df.collect() == []


def test_components(spark):
    from tracewell.llm.common import components

    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (7, 3), (200, 150), (150, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 199: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0
