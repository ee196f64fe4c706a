"""Plain versions of operators, one document or pair at a time."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, words: int = 4) -> frozenset:
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def near_duplicate_components(texts: dict[int, str | None], words: int = 4, percent: int = 80) -> dict[int, int]:
    sets = {k: shingle_set(t, words) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _valid(kind: str, value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        odd, even = digits[::-1][0::2], digits[::-1][1::2]
        return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return True


def base_spans(text: str | None) -> list[str]:
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PII.items()
        for m in pattern.finditer(text or "")
        if _valid(kind, m[0])
    ]


def targets(sizes: dict, weights=(5, 2, 1), budget=1.5, most=2) -> dict:
    """Share the budget by weight and hand on what is above a cap, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def source_words(rows) -> Counter:
    out: Counter = Counter()
    for _, text, _, source in rows:
        out[source] += len(WORD.findall(text or ""))
    return out
