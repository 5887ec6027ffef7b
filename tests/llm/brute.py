"""Plain versions of the operators, for comparison on small tables."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(ids, links):
    """Smallest id reachable, by id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def minhash(rows):
    """{id: (size, component)} over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids, links, by = list(sets), [], {}
    for i, s in sets.items():  # pairs that share a shingle
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            links.append((a, b))
    comp = closure(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}
