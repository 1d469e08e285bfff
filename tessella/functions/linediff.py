"""Line diffs as difflib has them, over integer-coded lines: equal stretches of a diagonal are found at once and shared out."""

from __future__ import annotations

import difflib

import numpy as np

PAIRS_AT_MOST = 1 << 24  # pairs of equal lines that are held; where there are more, difflib itself is slow but needs none
SHORT = 4_000  # products of line counts below which plain difflib is faster


def _stretches(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """(i, j, n) of the maximal stretches a[i : i + n] == b[j : j + n] of lines that b does not repeat too often; None if there are too many pairs."""
    often = np.bincount(b, minlength=int(max(a.max(initial=0), b.max(initial=0))) + 1)
    seed = often <= len(b) // 100 + 1 if len(b) >= 200 else np.ones(len(often), bool)  # difflib's rule for popular lines
    by_code = np.argsort(b, kind="stable")
    first = np.searchsorted(b[by_code], np.arange(len(often)))
    own = np.flatnonzero(seed[a] & (often[a] > 0))
    count = often[a[own]]
    if count.sum() > PAIRS_AT_MOST:
        return None
    i = np.repeat(own, count)
    j = by_code[np.repeat(first[a[own]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1))) if len(i) else np.zeros(0, np.int64)
    return np.stack([i[start], j[start], np.diff(np.append(start, len(i)))], axis=1)


def _clipped(parts: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Stretches cut to their boxes (a from, a to, b from, b to), row by row; empty ones have n <= 0."""
    cut = np.maximum(0, np.maximum(box[:, 0] - parts[:, 0], box[:, 2] - parts[:, 1]))
    i, j, n = parts[:, 0] + cut, parts[:, 1] + cut, parts[:, 2] - cut
    return np.stack([i, j, n - np.maximum(0, np.maximum(i + n - box[:, 1], j + n - box[:, 3]))], axis=1)


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """SequenceMatcher(None, a, b).get_matching_blocks().

    Of a box of lines the longest stretch is matched, of equally long ones the first, and widened over popular lines; the
    same is done with what lies before and after it. All stretches of the greatest length that follow one another are
    taken together, so that boxes get shorter stretches at each turn and every stretch is looked at once a turn.
    """
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(line, len(codes)) for line in text], dtype=np.int64) for text in (a, b))
    parts = _stretches(x, y) if len(a) * len(b) > SHORT else None
    if parts is None:
        return [tuple(m) for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()]
    xs, ys = x.tolist(), y.tolist()
    found, stack = [], [((0, len(a), 0, len(b)), parts)]
    while stack:
        (a0, a1, b0, b1), parts = stack.pop()
        if not len(parts):  # popular lines only: what is equal from the start on is matched
            n = 0
            while a0 + n < a1 and b0 + n < b1 and xs[a0 + n] == ys[b0 + n]:
                n += 1
            if n:
                found.append((a0, b0, n))
            continue
        most = parts[:, 2].max()
        longest = parts[parts[:, 2] == most]
        gaps = []
        for i, j, n in longest[np.lexsort((longest[:, 1], longest[:, 0]))].tolist():
            if i < a0 or j < b0:
                continue
            while i > a0 and j > b0 and xs[i - 1] == ys[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
            while i + n < a1 and j + n < b1 and xs[i + n] == ys[j + n]:
                n += 1
            found.append((i, j, n))
            gaps.append((a0, i, b0, j))
            a0, b0 = i + n, j + n
        box = np.array([*gaps, (a0, a1, b0, b1)], dtype=np.int64)
        lo = np.searchsorted(box[:, 1], parts[:, 0], side="right")
        hi = np.searchsorted(box[:, 0], parts[:, 0] + parts[:, 2], side="left")
        times = np.maximum(hi - lo, 0)
        where = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pieces = _clipped(np.repeat(parts, times, axis=0), box[where])
        where, pieces = where[pieces[:, 2] > 0], pieces[pieces[:, 2] > 0]
        order = np.argsort(where, kind="stable")
        where, pieces = where[order], pieces[order]
        edges = np.searchsorted(where, np.arange(len(box) + 1))
        stack += [(tuple(x), pieces[s:e]) for x, s, e in zip(box.tolist(), edges, edges[1:]) if x[0] < x[1] and x[2] < x[3]]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return [*out, (len(a), len(b), 0)]


def _span(start: int, stop: int) -> str:
    size = stop - start
    return f"{start + 1}" if size == 1 else f"{start + (size > 0)},{size}"


def unified_lines(a: list[str], b: list[str], old: str, new: str) -> list[str]:
    """The unified diff of two texts' lines, with three lines around each change."""
    matcher = difflib.SequenceMatcher(None, [], [])
    matcher.a, matcher.b, matcher.matching_blocks = a, b, matching_blocks(a, b)
    out: list[str] = []
    for group in matcher.get_grouped_opcodes(3):
        if not out:
            out += [f"--- {old}", f"+++ {new}"]
        out.append(f"@@ -{_span(group[0][1], group[-1][2])} +{_span(group[0][3], group[-1][4])} @@")
        for kind, i1, i2, j1, j2 in group:
            if kind == "equal":
                out += [" " + line for line in a[i1:i2]]
            else:
                out += ["-" + line for line in a[i1:i2]] + ["+" + line for line in b[j1:j2]]
    return out
