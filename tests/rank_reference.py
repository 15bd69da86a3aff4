"""Keyword ranking of a small corpus, worked out document by document."""

import math
from collections import Counter


def topk(docs, queries, k, k1=1.5, b=0.75, epsilon=0.25):
    words = {i: Counter(t.split()) for i, t in docs}
    n = len(words)
    mean = sum(sum(c.values()) for c in words.values()) / n
    df = Counter(w for c in words.values() for w in c)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for qid, q in queries.items():
        scored = []
        for i, c in words.items():
            part = k1 * (1 - b + b * sum(c.values()) / mean)
            scored.append((sum(idf[w] * c[w] * (k1 + 1) / (c[w] + part) for w in q.split() if c[w]), i))
        scored.sort(key=lambda x: (-round(x[0], 9), x[1]))
        out[qid] = [(i, round(s, 9)) for s, i in scored[:k]]
    return out
