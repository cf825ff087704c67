"""Plain versions of the learned operators' scoring, one text and one number at a time."""

import math
import re

from alpenglow.llm.secret_scan import BENIGN, KEYWORDS, PATHLIKE, PREFIXES
from alpenglow.llm.vector import BASES, MIX

FULL = (1 << 64) - 1


def mixed(h):
    for m in MIX:
        h = (h ^ h >> 33) * m & FULL
    return h ^ h >> 33


def poly(raw):
    """The polynomial hash of some bytes, mixed with their number."""
    h = sum((c + 1) * pow(BASES[0], i, 1 << 64) for i, c in enumerate(raw)) & FULL
    return mixed((h + BASES[1] * len(raw)) & FULL)


def terms(text):
    out = set()
    for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode()):
        out.add(poly(w))
        out |= {poly(w[:n]) ^ (k + 1) for k, n in enumerate((4, 5, 6)) if len(w) > n}
    return out


def toxicity(model, text):
    """sigmoid(bias + weights + an inner product of factors for each pair)."""
    have = terms(text)
    at = [i for i, h in enumerate(model.known.tolist()) if h in have]
    z = model.bias + sum(model.weight[i] for i in at)
    z += sum(float(model.factor[i] @ model.factor[j]) for n, i in enumerate(at) for j in at[:n])
    return 1 / (1 + math.exp(-min(max(z, -50), 50)))


def features(words, table, raw, a, b):
    """The sixteen features of the candidate ``raw[a:b]``."""
    value, before, after = raw[a:b], raw[max(0, a - 48) : a], raw[b : b + 24]
    near, n = before.rsplit(b"\n", 1)[-1], len(value)
    kind = [0 if chr(c).isdigit() else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in value]
    code = [c - 97 if 97 <= c <= 122 else 26 if 48 <= c <= 57 else 27 for c in value.lower()]
    share = [value.count(c) / n for c in set(value)]
    text, at, covered = value.decode().lower(), 0, 0
    while at + 4 <= n:
        k = next((k for k in range(14, 3, -1) if at + k <= n and text[at : at + k] in words), 0)
        covered, at = covered + k, at + max(k, 1)
    return [
        n, sum(x != y for x, y in zip(kind, kind[1:])) / (n - 1), sum(table[x][y] for x, y in zip(code, code[1:])) / (n - 1), covered / n,
        kind.count(0) / n, kind.count(1) / n, all(chr(c) in "0123456789abcdefABCDEF" for c in value), len(share) / n, -sum(s * math.log2(s) for s in share), value.count(b"/"),
        bool(PATHLIKE.search(near[-24:] + value + after[:8])), near.rstrip(b" \"'")[-1:] in (b"=", b":"), bool(KEYWORDS.search(near)), bool(BENIGN.search(near + b" " + after)),
        any(value.startswith(p.encode()) for p in PREFIXES), (near[-1:] >= b"\x80") + (after[:1] >= b"\x80"),
    ]


def forest(trees, x):
    """Mean share of secrets of the leaves that x falls into."""

    def walk(tree, at=0):
        feature, threshold, left, right, value = (c[at] for c in tree)
        return value if feature < 0 else walk(tree, left if x[feature] <= threshold else right)

    return sum(walk(t) for t in trees) / len(trees)
