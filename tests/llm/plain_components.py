"""Components of linked documents, the plain way."""

from __future__ import annotations

from collections import Counter, defaultdict


def components(texts):
    sets = []
    for i, text in texts:
        words = (text or "").encode().lower().split()
        sets.append((i, {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()))
    parent = list(range(len(sets)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = defaultdict(list)
    for a, (_, own) in enumerate(sets):
        common = Counter(b for s in own for b in seen[s])
        for s in own:
            seen[s].append(a)
        for b, both in common.items():
            if 100 * both >= 85 * (len(own) + len(sets[b][1]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, len(own), least[root(a)]) for a, (i, own) in enumerate(sets))
