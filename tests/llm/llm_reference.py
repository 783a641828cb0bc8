"""Plain versions that the operators are tested against."""

import re
from collections import Counter

import xxhash


def simhash64(text, words):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    tokens = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, budget):
    """Smallest key that links of at most ``budget`` differing bits reach."""
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: root(k) for k in prints}


def clean_lines(docs, min_chars=40, min_docs=5):
    """``{id: kept lines}`` of ``{id: text}``."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))

    held, top = Counter(), {}
    for i, text in docs.items():
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] += 1
            top[k] = max(top.get(k, i), i)
    gone = {k for k, n in held.items() if n >= min_docs and len(k) >= min_chars}
    return {i: [x for x in (t or "").split("\n") if key(x) not in gone or top[key(x)] == i] for i, t in docs.items()}


def edf(slots, period):
    """``[(source, turn)]`` of one period: in each slot the released block with the earliest deadline."""
    turn, out = [0] * len(slots), []
    for t in range(period):
        ready = [((k + 1) * period + w - 1) // w * 10_000 + s for s, (k, w) in enumerate(zip(turn, slots))
                 if k < w and k * period // w <= t]
        s = min(ready) % 10_000
        out.append((s, turn[s]))
        turn[s] += 1
    return out
