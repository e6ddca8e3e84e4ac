"""Plain-Python versions of what the corpus operators compute, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def by_space(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def by_sign(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def shingles(text, width):
    w = by_space(text)
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def classes(texts, width, percent):
    """{id: least id that links lead to} for {id: text}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def repeated_words(texts, least):
    """{id: word places covered by a run of ``least`` words that another text holds}."""
    words, held = {i: by_space(t) for i, t in texts.items()}, defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            held[tuple(w[k:k + least])].add(i)
    out = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            if len(held[tuple(w[k:k + least])]) > 1:
                out[i].update(range(k, k + least))
    return dict(out)


def contaminated(text, windows):
    w = by_sign(text)
    return any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))


def windows_of(items, width=10):
    out = set()
    for t in items:
        w = by_sign(t)
        n = min(width, len(w))
        out |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
    return out
