"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for i, t in docs:
        n = (t or "").translate(UPPER)
        ids = groups[n]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep if len(ids) > 1 else i, len(ids), i == keep if len(ids) > 1 else True, hashlib.sha256(n.encode()).hexdigest()))
    return out


def fingerprint(text, width=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, width=3, threshold=2):
    prints = {k: fingerprint(t, width) for k, (_, t) in enumerate(docs)}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = i if r not in least or (i is not None and (least[r] is None or i < least[r])) else least[r]
    return [(i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs)]


def similar(docs, least=0.8, width=5):
    """Pairs of ids whose shingle sets overlap by ``least`` or more."""
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}))
    return [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if len(x & y) >= least * len(x | y)]


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def repeats(docs, length=50):
    """(id, n_bytes, n_removed, n_spans, digest of what is left) by row."""
    big = 2**63 - 1
    first = {}
    rows = [(big if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, big), i)
    out = []
    for (i, b), (own, _) in zip(rows, docs):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((own, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]
