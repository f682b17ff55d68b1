"""Plain versions of the training-data operators, for small inputs."""

import re
from collections import defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\x0b\x0c\r"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(texts, percent=75):
    sets = {d: shingles(t) for d, t in texts.items()}
    shared = defaultdict(int)
    holders = defaultdict(list)
    for d in sorted(sets):
        for g in sets[d]:
            for other in holders[g]:
                shared[other, d] += 1
            holders[g].append(d)
    links = [(a, b) for (a, b), c in shared.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return roots(sets, links), {d: len(s) for d, s in sets.items()}


def leaks(texts, items, percent=75):
    sets = {i: shingles(t) for i, t in items.items()}
    out = set()
    for d, t in texts.items():
        own = shingles(t)
        out |= {(d, i) for i, s in sets.items() if s and 100 * len(own & s) >= percent * len(s)}
    return out


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def line_classes(rows, edits=2, fuzzy_from=40):
    """rows: (doc_id, text) -> {(doc_id, line_no): (first line of the class, size)}"""
    places = defaultdict(list)
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(SPACE):
                places[line.strip(SPACE)].append((d, n))
    names = sorted(places)
    long = [x for x in names if len(x) >= fuzzy_from]
    links = [(a, b) for i, a in enumerate(long) for b in long[:i] if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits]
    classes = defaultdict(list)
    for name, root in roots(names, links).items():
        classes[root] += places[name]
    return {p: (min(c), len(c)) for c in classes.values() for p in c}
