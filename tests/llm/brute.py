"""Plain statements of what the operators compute, for small inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def removed_lines(docs):
    """doc_id -> numbers of lines that an earlier line matches; docs sorted by id."""
    lines = [(i, k, frozenset(x.encode().lower().split())) for i, t in docs for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = defaultdict(list)
    for n, (i, k, s) in enumerate(lines):
        if any(5 * len(s & u) >= 4 * len(s | u) for _, _, u in lines[:n] if 4 * len(s) <= 5 * len(u) and 4 * len(u) <= 5 * len(s)):
            gone[i].append(k)
    return gone


def simhash(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    n = min(words, len(w))
    h = [xxhash.xxh64(b" ".join(w[i:i + n]), seed=42).intdigest() for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, most=4):
    """id -> smallest id reachable."""
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= most
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def repeats(docs, n=50):
    """doc_id -> (bytes, removed, spans, kept bytes); docs sorted by id, ids distinct."""
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        mine = {b[s:s + n] for s in range(len(b) - n + 1)}
        for s in range(len(b) - n + 1):
            if b[s:s + n] in seen:
                gone[s:s + n] = True
        seen |= mine
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def raked(weights, targets, rounds=200):
    """weights {(a, b, c): w}; targets one {value: share} per place."""
    w = dict(weights)
    for _ in range(rounds):
        for place, goal in enumerate(targets):
            total = Counter()
            for key, x in w.items():
                total[key[place]] += x
            w = {key: x * goal[key[place]] / total[key[place]] for key, x in w.items()}
    return w


def tempered(weights, place, power):
    total = Counter()
    for key, x in weights.items():
        total[key[place]] += x
    p = {v: x ** power for v, x in total.items()}
    return {v: x / math.fsum(p.values()) for v, x in p.items()}


def code_lengths(taught, texts, order=3):
    """Bits of each text under each label, by walking down from the longest context, a byte at a time."""
    trees = {}
    for label, text in taught:
        b = bytes(order) + text.encode()
        for i in range(order, len(b)):
            for n in range(order + 1):
                trees.setdefault(label, defaultdict(Counter))[b[i - n:i]][b[i]] += 1
    out = []
    for text in texts:
        b, bits = bytes(order) + text.encode(), {}
        for label in sorted(trees):
            tree, total = trees[label], 0.0
            for i in range(order, len(b)):
                for n in range(order, -2, -1):
                    if n < 0:
                        total += 8
                        break
                    seen = tree.get(b[i - n:i])
                    if seen:
                        size, kinds = sum(seen.values()), len(seen)
                        total -= math.log2((seen[b[i]] or kinds) / (size + kinds))
                        if seen[b[i]]:
                            break
            bits[label] = total
        out.append(bits)
    return out


def ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    """rows: sets of feature names. (weights, bias) of FTRL-proximal, coordinate by coordinate."""
    z, n = Counter(), Counter()

    def weight(x):
        limit = 0 if x is None else l1
        if abs(z[x]) <= limit:
            return 0.0
        return -(z[x] - math.copysign(limit, z[x])) / ((beta + math.sqrt(n[x])) / alpha + l2)
    for _ in range(epochs):
        for f, y in zip(rows, labels):
            w = {x: weight(x) for x in [*f, None]}
            g = 1 / (1 + math.exp(-max(-35, min(35, math.fsum(w.values()))))) - y
            for x, old in w.items():
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / alpha * old
                n[x] += g * g
    return {x: weight(x) for x in z if x is not None and weight(x)}, weight(None)
