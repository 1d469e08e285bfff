"""Plain Python versions of the operators' definitions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def crc(key) -> int:
    return zlib.crc32(str(key).encode())


def shingles(text: str | None, k: int = 4) -> frozenset:
    w = spaced(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked doc_id) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def base_spans(text: str | None) -> list[str]:
    out = []
    for order, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": kind != "card" or (12 <= len(d) <= 19 and luhn(d)), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def contamination(docs: list[tuple], items: list[tuple], width: int = 10) -> dict[int, tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(g) for g in windows}
    out = {}
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


def near_items(docs: list[tuple], items: list[tuple], width: int = 10, slop: int = 2, share: float = 0.8) -> dict[int, int]:
    """doc_id -> items of which a window stands nearby, every start tried that one of its rarest words gives."""
    texts = {i: alnum(t) for i, t in docs}
    count = Counter(w for words in texts.values() for w in words)
    out = {}
    for i, words in texts.items():
        places, found = defaultdict(list), set()
        for p, w in enumerate(words):
            places[w].append(p)
        for item, text in items:
            own = alnum(text)
            for b in range(max(1, len(own) - width + 1) if own else 0):
                window = own[b : b + width]
                need = math.ceil(share * len(window))
                rarest = sorted((o for o in range(len(window)) if count[window[o]]), key=lambda o: (count[window[o]], o))[: len(window) - need + 1]
                starts = {p - o for o in rarest for p in places[window[o]]}
                if any(sum(any(abs(p - s - o) <= slop for p in places[w]) for o, w in enumerate(window)) >= need for s in starts):
                    found.add(item)
        out[i] = len(found)
    return out
