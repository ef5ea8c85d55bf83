"""Plain versions of the operators, slow and simple, to hold results against."""
import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality_counts(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
            "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n}


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in counts if 2 * counts[b] > len(shingles))


def near(rows):
    """[(id, fingerprint, smallest id connected)] of (id, text) rows."""
    prints = np.array([fingerprint(t or "") for _, t in rows], np.uint64)
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= 4) + i + 1:
            group[top(int(j))] = top(i)
    lowest = {}
    for i, (row_id, _) in enumerate(rows):
        if row_id is not None:
            lowest[top(i)] = min(lowest.get(top(i), row_id), row_id)
    return [(row_id, f"{int(prints[i]):016x}", lowest.get(top(i))) for i, (row_id, _) in enumerate(rows)]


def substrings(rows, length=50):
    """[(id, bytes, removed, runs, digest)]; a null id is larger than all others."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for row_id, text in order:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p:p + length], (row_id is None, row_id or 0))
    out = []
    for row_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            if first[data[p:p + length]] < (row_id is None, row_id or 0):
                gone[p:p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out.append((row_id, len(data), int(gone.sum()), len(edges) // 2, sha(kept)))
    return out


def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def listed(found, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def secret_spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return listed(found, ("assign", "access", "hex"))


def personal_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return listed(found, ("email", "ip", "card", "phone"))


def overlap(doc, item):
    """(equal words, place) of the best alignment of an item, or None."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    words, own = split(doc), split(item)
    n = len(own)
    size = min(n, 20)
    wanted = n if n < 15 else -(-size * 8 // 10)
    best = None
    for at in range(-n + 1, len(words)):
        same = [0 <= at + j < len(words) and words[at + j] == own[j] for j in range(n)]
        top = max((sum(same[i:i + size]) for i in range(n - size + 1)), default=0)
        if n and top >= wanted and (best is None or top > best[0]):
            best = (top, at)
    return best
