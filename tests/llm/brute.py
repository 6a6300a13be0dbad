"""Brute-force versions of the operators."""

import hashlib
import re
from collections import Counter

import xxhash


def removed_bytes(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept hash)} by a dictionary of all strings."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


def components(prints, distance=4):
    """{doc_id: smallest doc_id reachable} of {doc_id: fingerprint}."""
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = sorted(prints)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in docs}


def leaks(docs, items, width=5, share=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return ({tuple(w)} if w else set()) if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    held = [(i, s) for i, t in items if (s := shingles(t))]
    return {(d, i) for d, t in docs for ds in [shingles(t)] for i, s in held if len(s & ds) >= share * len(s) - 1e-9}


def without_passages(rows, roll=2):
    """{doc_id: text} without the repeated windows of lines that hold a word, by a dictionary of all windows."""
    first, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        held = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for at in range(len(held) - roll + 1):
            e, j = first.setdefault(tuple(lines[i] for i in held[at : at + roll]), (d, at))
            if e != d or at > j + roll - 1:
                gone |= set(range(held[at], held[at + roll] if at + roll < len(held) else len(lines)))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def host_and_path(url):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", ""
    host = re.split("[/?#]", rest[1], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[1][len(host) :], maxsplit=1)[0]


def url_rule(url, rules):
    """The longest of the rules ("host/path": verdict) that fits a URL, or null."""
    host, path = host_and_path(url)
    fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)
