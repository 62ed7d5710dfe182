"""Plain versions of the contracts, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def simhash(rows, bits=3, size=3):
    """rows: (doc_id, text) -> {doc_id: (fingerprint, component)}"""
    fps = {}
    for doc, text in rows:
        words = WORD.findall((text or "").translate(A_Z))
        shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(fps)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (f"{fps[d]:016x}", root(d)) for d in docs}


def repeats(rows, window=20):
    """rows: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    gone = defaultdict(set)
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            if first.setdefault(tuple(words[d][i : i + window]), (d, i)) != (d, i):
                gone[d].update(range(i, i + window))
    return {d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in words.items()}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13):
    """-> {doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    grams = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(A_Z))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams[tuple(w[i : i + window])].add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in rows:
        w = BENCH_WORD.findall((text or "").translate(A_Z))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= g
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def feistel(key, tweak, x, n):
    """A plain balanced network over pairs below ceil(sqrt(n)), ten rounds, walking until the image is below n."""
    side = math.isqrt(n - 1) + 1
    secret = hashlib.blake2b(key, digest_size=32).digest()
    while n > 1:
        a, b = x // side, x % side
        for r in range(10):
            raw = hashlib.shake_256(secret + f"{r}|{n}|{b}|{tweak}".encode()).digest(side.bit_length() // 8 + 9)
            a, b = b, (a + int.from_bytes(raw, "big")) % side
        x = a * side + b
        if x < n:
            break
    return x


def pseudonymized(text, key, kinds):
    """Every place of the whole text is tried with every kind in turn, and there every end at a separator, longest first."""
    out, at, counts = [], 0, {}
    while at < len(text):
        found = None
        for kind, pattern, become in kinds:
            m = re.compile(pattern).match(text, at)
            if m is None or found:
                continue
            ends = [m.end()]
            if kind in ("card", "iban") or kind == "phone" and text[at] == "+":
                parts = " \u00a0\u2009\u202f.-\r\n"
                ends += [e for e in range(m.end() - 1, at, -1) if text[e] in parts and text[e - 1] not in parts and re.match("[0-9A-Za-z]", text[e:].lstrip(parts))]
            for end in ends:
                new = become(text[at:end], lambda tweak, x, n: feistel(key, tweak, x, n))
                if new is not None and not found:
                    found = (kind, end, new)
        if found:
            counts[found[0]] = counts.get(found[0], 0) + 1
            out.append(found[2])
            at = found[1]
        else:
            out.append(text[at])
            at += 1
    return "".join(out), counts
