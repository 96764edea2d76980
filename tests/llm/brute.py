"""Plain single-machine versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen: set[str] = set()
    dup = 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    hit = {j for i, g in enumerate(grams) if many[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def base_failed(text: str | None) -> bool:
    n, _, _, _, rep = statistics(text)
    return n < 50 or 100 * rep > 50 * n


def stripped(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def shingles(text: str | None, width: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    n = min(width, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def components(texts: dict, width: int, percent: int) -> dict:
    sets = {k: shingles(t, width) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def removed(texts: list[bytes], window: int) -> list[tuple[int, int, int, str]]:
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = True
        spans = int(np.sum(gone[1:] & ~gone[:-1])) + int(len(t) > 0 and gone[0])
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def draw(doc_id) -> float:
    return int(hashlib.md5(str(doc_id).encode()).hexdigest()[:13], 16) / 2 ** 52


def topic(text: str | None) -> str:
    t = text or ""
    if 50 * len(re.findall(r"[0-9#*$%&|<>{}=@_]", t)) > len(t):
        return "technical"
    return "dialogue" if 250 * len(re.findall(r'["?!]', t)) > len(t) else "prose"


def probabilities(cells: dict, temper: dict, dims: list[str], budget: float) -> dict:
    """Raking and the exact common factor. cells: (source, lang, topic) -> tokens."""
    keys = [k for k in cells if cells[k] > 0]
    w = {k: float(cells[k]) for k in keys}
    goals = []
    for d, dim in enumerate(dims):
        n = Counter()
        for k in keys:
            n[k[d]] += cells[k]
        part = {c: v ** temper[dim] for c, v in n.items()}
        goals.append({c: v / sum(part.values()) for c, v in part.items()})
    for _ in range(300):
        for d in range(len(dims)):
            now = Counter()
            for k in keys:
                now[k[d]] += w[k]
            for k in keys:
                w[k] *= goals[d][k[d]] / now[k[d]]
    total = sum(cells[k] for k in keys)
    low, high = 0.0, max((cells[k] / w[k] for k in keys), default=1.0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cells[k], w[k] * mid) for k in keys) < budget * total else (low, mid)
    return {k: 1.0 if k not in w else min(1.0, w[k] * high / cells[k]) for k in cells}
