"""Plain Python versions of the landscape definitions, for small landscapes."""

from __future__ import annotations

import itertools
import math
from statistics import fmean, pstdev


class Brute:
    """``cfgs``: code tuples, ``f``: fitness, ``kinds`` of the positions; ids are list positions."""

    def __init__(self, cfgs, f, kinds, maximize=True, epsilon=0.0):
        self.cfgs, self.f, self.kinds, self.maximize, self.epsilon = cfgs, f, kinds, maximize, epsilon
        self.n = len(cfgs)
        bound = 0.0 if epsilon <= 0 else math.nextafter(epsilon, math.inf)
        self.edges, self.neutral = set(), set()
        for i, j in itertools.combinations(range(self.n), 2):
            if self.linked(i, j):
                if abs(f[i] - f[j]) <= bound:
                    self.neutral.add((i, j))
                else:
                    self.edges.add((i, j) if (f[i] < f[j]) == maximize else (j, i))
        self.out = {i: sorted(b for a, b in self.edges if a == i) for i in range(self.n)}
        self.plateau = list(range(self.n))
        for _ in range(self.n):
            for i, j in self.neutral:
                self.plateau[i] = self.plateau[j] = min(self.plateau[i], self.plateau[j])
        self.members = {r: [i for i in range(self.n) if self.plateau[i] == r] for r in set(self.plateau)}

    def linked(self, i, j):
        differ = [p for p in range(len(self.kinds)) if self.cfgs[i][p] != self.cfgs[j][p]]
        return len(differ) == 1 and (self.kinds[differ[0]] != "ordinal" or abs(self.cfgs[i][differ[0]] - self.cfgs[j][differ[0]]) == 1)

    def exits(self, root):
        """First-improvement exits of a plateau in order."""
        m = self.members[root]
        best = (max if self.maximize else min)(self.f[i] for i in m)
        gain = lambda i: self.f[i] - best if self.maximize else best - self.f[i]
        return [(i, j) for i in m for j in self.out[i] if self.plateau[j] != root and gain(j) > self.epsilon]

    def is_lo(self, i):
        m = self.members[self.plateau[i]]
        return not self.exits(self.plateau[i]) if len(m) > 1 else not self.out[i]

    def basin(self, i):
        if self.is_lo(i):
            return self.plateau[i], 0
        steps = 0
        while True:
            while self.out[i]:
                i = max(self.out[i], key=lambda j: (self.f[j], -j))
                steps += 1
            if self.is_lo(i):
                return self.plateau[i], steps
            i = self.exits(self.plateau[i])[0][1]
            steps += 1

    def ancestors(self, targets):
        found = set(targets)
        while more := {a for a, b in self.edges if b in found} - found:
            found |= more
        return found

    def gamma(self):
        top = bottom = 0.0
        at = {c: i for i, c in enumerate(self.cfgs)}
        levels = [sorted({c[p] for c in self.cfgs}) for p in range(len(self.kinds))]
        for p, q in itertools.permutations(range(len(self.kinds)), 2):
            for c in self.cfgs:
                for b in levels[p]:
                    for d in levels[q]:
                        if b > c[p] and d > c[q]:
                            put = lambda **k: at.get(tuple(k.get(f"x{i}", v) for i, v in enumerate(c)))
                            i, j, k, m = at[c], put(**{f"x{p}": b}), put(**{f"x{q}": d}), put(**{f"x{p}": b, f"x{q}": d})
                            if None not in (j, k, m):
                                e, g = self.f[j] - self.f[i], self.f[m] - self.f[k]
                                top, bottom = top + e * g, bottom + (e * e + g * g) / 2
        return top / bottom if bottom else float("nan")

    def idiosyncratic(self):
        sd, out = pstdev(self.f), []
        for p in range(len(self.kinds)):
            levels = sorted({c[p] for c in self.cfgs})
            for a, b in itertools.combinations(levels, 2):
                at = {c[:p] + c[p + 1 :]: f for c, f in zip(self.cfgs, self.f) if c[p] == a}
                effects = [f - at[c[:p] + c[p + 1 :]] for c, f in zip(self.cfgs, self.f) if c[p] == b and c[:p] + c[p + 1 :] in at]
                if len(effects) >= 3:
                    out.append(pstdev(effects) / (math.sqrt(2) * sd))
        return fmean(out)

    def cycles(self):
        """Kinds of all induced cycles of four improving edges: counts of (magnitude, sign, reciprocal)."""
        both = self.edges | {(b, a) for a, b in self.edges}
        count = {"magnitude": 0, "sign": 0, "reciprocal_sign": 0}
        for four in itertools.combinations(range(self.n), 4):
            if all(sum((i, j) in both for j in four) == 2 for i in four):
                into = {i: sum((j, i) in self.edges for j in four) for i in four}
                low, high = [i for i in four if into[i] == 0], [i for i in four if into[i] == 2]
                kind = "reciprocal_sign" if len(low) == 2 else "magnitude" if (low[0], high[0]) not in both else "sign"
                count[kind] += 1
        total = sum(count.values())
        return {k: v / total for k, v in count.items()}
