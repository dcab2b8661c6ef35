"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import Counter

SPACE = b" \t\n\v\f\r"


def space_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_words(text):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def shingles(text, size):
    w = space_words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(nodes, links):
    """The smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_links(sets, percent):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def water_fill(sizes, weights, epochs):
    """Targets by clamping one source after the other."""
    left, total, target = dict(zip(sizes, weights)), sum(sizes.values()), {}
    while left:
        level = (total - sum(target.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > epochs * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in left.items()}
        for s in over:
            target[s] = epochs * sizes[s]
            del left[s]
    return target


def best_overlap(doc, item, max_substituted):
    """(words, equal words) of the longest run over all shifts."""
    best = (0, 0)
    for shift in range(-len(item) + 1, len(doc)):
        same = [doc[i + shift] == w for i, w in enumerate(item) if 0 <= i + shift < len(doc)]
        for a in range(len(same)):
            for b in range(a + 1, len(same) + 1):
                equal = sum(same[a:b])
                if same[a] and same[b - 1] and (b - a - equal) <= max_substituted * (b - a) + 1e-9:
                    best = max(best, (b - a, equal))
    return best


def unigrams(texts):
    counts = Counter()
    for t in texts:
        counts.update([*space_words(t), b"\n"])
    return counts
