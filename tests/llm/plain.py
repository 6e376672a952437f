"""Slow versions of the operators, from their definitions alone, that several tests share."""

import math
import re
from collections import Counter, defaultdict

from blockwright.llm import toxicity


def water_filling(sizes, weights, most=3):
    """Targets by resharing the excess until none is above, as the definition says."""
    target = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / w for s in open_}
        over = {s for s in open_ if target[s] + share[s] > most * sizes[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] += share[s]
            break
        for s in over:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= over
    return target


def plain_score(text, lexicon, fit):
    """A slow scorer: every entry is looked for at every place."""
    t = toxicity.folded(text or "")
    exempt = set()
    for p in toxicity.EXCEPTIONS:
        p = f" {toxicity.folded(p).strip()} "
        for s in range(len(t)):
            if t.startswith(p, s):
                exempt |= set(range(s, s + len(p) - 1))
    hits = defaultdict(int)
    for s in range(len(t)):
        found = [w for e, w in lexicon.items() if t.startswith(e, s)]
        if found and s not in exempt:
            hits[max(found), t[s:].split(" ")[1]] += 1
    weight = sum(w * (1 + math.log(n)) for (w, _), n in hits.items())
    x = math.log1p(4 * weight / math.sqrt(len(t.split()) + toxicity.PAD_WORDS))
    return 1 / (1 + math.exp(-(fit[0] * x + fit[1])))


def weights(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in {*x, *y}) for i in x if i in y)


def near_groups(rows):
    """The group of each text, by comparing all pairs; equal texts are in one, and texts without words alone."""
    texts = sorted({t for _, t, *_ in rows if t is not None})
    sets, parent = [weights(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    return {t: find(k) for k, t in enumerate(texts)}
