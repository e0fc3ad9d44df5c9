"""Plain Python versions of what the operators compute, for small inputs."""

import re


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, width, lower=True):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if lower else text or ""
    w = words(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def components(sets, p, q):
    """Smallest key reached from each key by links of a similarity of p / q or more."""
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and q * len(x & y) >= p * len(x | y):
                a_top, b_top = find(a), find(b)
                top[max(a_top, b_top)] = min(a_top, b_top)
    return {k: find(k) for k in keys}


def base_rules(text):
    w, t = words(text), text or ""
    windows, at = {}, set()
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    for found in windows.values():
        if len(found) > 1:
            at.update(i + k for i in found for k in range(3))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup,
            "n_repeat_words": len(at), "base_failed": len(w) < 50 or 100 * len(at) > 50 * len(w)}


def contained(doc, item):
    def five(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    x, y = five(doc), five(item)
    return bool(y) and 5 * len(x & y) >= 4 * len(y)
