"""Plain single-process versions that the operators are held against."""

import hashlib
from collections import defaultdict

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def stats(text):
    text = text or ""
    w = words(text)
    seen = set()
    dups = 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def line_key(line):
    return lower(line.strip(SPACES))


def dedup_lines(docs):
    """docs: (id, text) with distinct ids."""
    held = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            held[line_key(line)].add(d)
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or min(held[line_key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    import xxhash

    w = words(lower(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(prints):
    """prints: {id: fingerprint} -> {id: smallest reachable id}."""
    sets, ids = Sets(), sorted(prints)
    for i, a in enumerate(ids):
        sets.find(a)
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    return {d: sets.find(d) for d in ids}


def shingle_set(line):
    w = words(lower(line))
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1) if n)


def near_paragraphs(docs):
    """{(id, place): (first (id, place), size)} of paragraphs with a near copy."""
    spots = [(d, k, s) for d, text in docs for k, line in enumerate((text or "").split("\n")) if (s := shingle_set(line))]
    by = defaultdict(list)
    for d, k, s in spots:
        by[s].append((d, k))
    sets, kinds = Sets(), list(by)
    index = defaultdict(set)
    for i, s in enumerate(kinds):
        sets.find(i)
        for j in {j for g in s for j in index[g]}:
            inter = len(s & kinds[j])
            if inter >= 0.8 * (len(s) + len(kinds[j]) - inter):
                sets.join(i, j)
        for g in s:
            index[g].add(i)
    members = defaultdict(list)
    for i, s in enumerate(kinds):
        members[sets.find(i)] += by[s]
    return {x: (min(m), len(m)) for m in members.values() if len(m) > 1 for x in m}


def remove_repeats(docs, length=400):
    """docs: (key, text) rows -> {key: (n_bytes, n_removed, n_spans, sha256)}."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    count = defaultdict(int)
    for _, b in raw:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = {}
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), len(b) - len(kept), spans, sha(kept))
    return out
