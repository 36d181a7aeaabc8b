"""Plain versions of the corpus operators, for small inputs."""

import collections
import re

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACES.findall(text or "")


def runs(items, n):
    return {tuple(items[i : i + n]) for i in range(max(1, len(items) - n + 1))} if items else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def joined(keys, sets, similar):
    """Root of each key under links of all pairs whose sets are similar."""
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if jaccard(sets[a], sets[b]) >= similar:
                up[find(a)] = find(b)
    return {k: find(k) for k in keys}


def near(rows):
    """Class of each (doc_id, text) row as a set of row numbers."""
    texts = {t or "" for _, t in rows}
    root = joined(texts, {t: runs(words(t), 5) for t in texts}, 0.8)
    out = collections.defaultdict(set)
    for k, (_, t) in enumerate(rows):
        out[root[t or ""]].add(k)
    return sorted(map(sorted, out.values()))


def line_places(rows):
    """Class of each line as a list of (row, line), for lines that are not blank."""
    at = collections.defaultdict(list)
    for k, (_, t) in enumerate(rows):
        for n, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" \t\n\r\x0b\x0c"):
                at[line].append((k, n))
    root = joined(at, {x: runs(x, 8) for x in at}, 0.8)
    out = collections.defaultdict(list)
    for line, places in at.items():
        out[root[line]] += places
    return sorted(map(sorted, out.values()))


def repetition(text):
    w = words(text)

    def inside(k):
        seen = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    for k in range(1, len(w)):
        if not inside(k):
            break
        longest = k
    lines = [x for x in (text or "").split("\n") if words(x)]
    eight, five = inside(8), inside(5)
    failed = len(w) < 20 or 100 * eight > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), eight, five, longest, failed,
            not failed and five <= 0.4 * len(w) and longest <= 50)


def item_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, items, window=10):
    w, hit, found = item_words(text), set(), set()
    for name, item in items:
        b = item_words(item)
        k = min(window, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)
