"""Plain versions of what the operators compute."""

import hashlib
import re
import unicodedata  # noqa: F401
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(n, linked):
    """Smallest index reachable, by union-find over ``linked`` pairs."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def contamination(text, items, width=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = pattern.findall(lower(t))
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            windows[tuple(w[i:i + width])].add(item)
    w = pattern.findall(lower(text))
    hit, found = set(), set()
    for size in {len(k) for k in windows}:
        for i in range(len(w) - size + 1):
            owners = windows.get(tuple(w[i:i + size]))
            if owners:
                hit.update(range(i, i + size))
                found |= owners
    return len(w), len(hit), sorted(str(f) for f in found if f is not None)


def word_counts(texts):
    counts = Counter()
    for t in texts:
        counts.update(WORD.findall(lower(t)))
        counts[None] += 1
    return counts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shingles(line, n=5):
    return {line[i:i + n] for i in range(max(1, len(line) - n + 1))}


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0
