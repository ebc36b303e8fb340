"""Brute-force helpers that several tests share."""

from collections import defaultdict


def shingles(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_groups(texts, empty_link=False):
    """Sorted groups of the keys of ``texts`` by pairwise Jaccard similarity of at least 0.8."""
    sets, parent = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) or empty_link and not x and not y:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in keys:
        groups[root(k)].append(k)
    return sorted(groups.values())


def changed(rng, text, words):
    out = text.split()
    for i in rng.sample(range(len(out)), words):
        out[i] = f"new{rng.random()}"
    return " ".join(out)
