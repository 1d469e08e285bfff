"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax."""

from __future__ import annotations

import numpy as np

UNKNOWN, END = 0, 1
AT_ONCE = 2048  # rows of a softmax held together


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Adam:
    """Moments of the gradients of p, which it changes in place; gradients longer than 1 are shortened.

    A gradient is an array like its weights, or (rows, values) of the rows that a window touched: other rows stay as they
    are, so a move costs what the window holds and not what the vocabulary does.
    """

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.turn = p, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def move(self, g: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], rate: float) -> None:
        parts = {k: a if isinstance(a, tuple) else (slice(None), a) for k, a in g.items()}
        norm = np.sqrt(sum(float(np.vdot(a, a)) for _, a in parts.values()))
        self.turn += 1
        now = np.float32(rate * min(1.0, 1.0 / max(norm, 1e-9)) * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn))
        for k, (rows, a) in parts.items():
            m, v = self.m[k][rows], self.v[k][rows]
            t = a - m
            t *= np.float32(0.1)
            m += t
            np.multiply(a, a, out=t)
            t -= v
            t *= np.float32(0.001)
            v += t
            np.sqrt(v, out=t)
            t += np.float32(1e-8)
            np.divide(m, t, out=t)
            t *= now
            if not isinstance(rows, slice):
                self.m[k][rows], self.v[k][rows] = m, v
            self.p[k][rows] -= t


class GRU:
    """Word ids 0 (unknown), 1 (end) and up, by falling frequency; classes are runs of `width` ids."""

    def __init__(self, counts: np.ndarray, hidden: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words, self.hidden = len(counts), hidden
        self.width = max(2, int(np.ceil(np.sqrt(self.words))))
        self.classes = -(-self.words // self.width)
        size = self.classes * self.width
        mass = np.zeros(size)
        mass[: self.words] = counts + 0.5
        mass = mass.reshape(self.classes, self.width)
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(mass / mass.sum(axis=1, keepdims=True)), -1e9)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "x": small(self.words, 3 * hidden), "u": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32), "q": np.zeros(hidden, np.float32),
            "wc": small(hidden, self.classes), "bc": np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
            "wo": small(self.classes, hidden, self.width), "bo": inside.astype(np.float32),
        }

    def step(self, ids: np.ndarray, h: np.ndarray, keep: bool = False):
        """The next states; with keep also what the backward pass needs."""
        n = self.hidden
        x, hu = self.p["x"].take(ids, axis=0), h @ self.p["u"]
        gates = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        q = hu[:, 2 * n :] + self.p["q"]
        cand = np.tanh(x[:, 2 * n :] + r * q)
        new = cand + z * (h - cand)
        return (new, (h, z, r, q, cand)) if keep else new

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of ids by class, their classes and places in them in that order, and each class's run (class, first, last)."""
        cls = (ids // self.width).astype(np.int16 if self.classes < 1 << 15 else np.int64)
        order = np.argsort(cls, kind="stable")
        cls = cls[order].astype(np.int64)
        first = np.flatnonzero(np.diff(cls, prepend=-1))
        return order, cls, ids[order] - cls * self.width, list(zip(cls[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cls)]))

    def log_probs(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln P(id | state) = ln P(class) + ln P(word in class), rows grouped by class."""
        order, cls, slot, runs = self._by_class(ids)
        s = _with_ones(states, order)
        out = np.empty(len(s))
        (w, top), (inner, tops) = _with_bias(self.p["wc"], self.p["bc"]), _with_bias(self.p["wo"], self.p["bo"])
        for lo in range(0, len(s), AT_ONCE):
            out[lo : lo + AT_ONCE] = _log_share(s[lo : lo + AT_ONCE], w, top, cls[lo : lo + AT_ONCE])
        for c, first, last in runs:
            for lo in range(first, last, AT_ONCE):
                hi = min(last, lo + AT_ONCE)
                out[lo:hi] += _log_share(s[lo:hi], inner[c], tops[c], slot[lo:hi])
        back = np.empty(len(s))
        back[order] = out
        return back

    def loss_and_gradient(self, ids: np.ndarray, targets: np.ndarray, h: np.ndarray):
        """Mean loss over a (steps, lanes) window, its gradients, and the states after it."""
        steps, lanes = ids.shape
        n, p = self.hidden, self.p
        kind = p["u"].dtype
        tape, states = [], np.empty((steps, lanes, n), kind)
        for t in range(steps):
            begin = (ids[t] != END).astype(np.float32)[:, None]
            h, kept = self.step(ids[t], h * begin, True)
            tape.append((begin, kept))
            states[t] = h
        order, cls, slot, runs = self._by_class(targets.reshape(-1))
        flat = _with_ones(states.reshape(-1, n), order)
        total, d_flat = len(order), np.zeros((len(order), n), kind)
        seen = np.array([c for c, _, _ in runs])
        held = slice(None) if len(seen) == self.classes else seen
        (w, top), (inner, tops) = _with_bias(p["wc"], p["bc"]), _with_bias(p["wo"][held], p["bo"][held])
        outer, own = np.zeros_like(w), np.zeros_like(inner)
        loss = 0.0
        for lo in range(0, total, AT_ONCE):
            s = slice(lo, lo + AT_ONCE)
            loss += _share_gradient(flat[s], w, top, cls[s], total, d_flat[s], outer)
        for i, (c, first, last) in enumerate(runs):
            for lo in range(first, last, AT_ONCE):
                s = slice(lo, min(last, lo + AT_ONCE))
                loss += _share_gradient(flat[s], inner[i], tops[i], slot[s], total, d_flat[s], own[i])
        g = {"wc": outer[:-1], "bc": outer[-1], "wo": (held, np.ascontiguousarray(own[:, :-1])), "bo": (held, np.ascontiguousarray(own[:, -1]))}
        d_states, d_next = np.empty_like(d_flat), np.zeros((lanes, n), kind)
        d_states[order] = d_flat
        d_states = d_states.reshape(steps, lanes, n)
        before, z, r, q, cand = (np.stack(x) for x in zip(*(kept for _, kept in tape)))
        slope = np.empty((steps, lanes, 3, n), kind)  # of the inputs of z, r and the candidate, by the state; all but d_next is known before the steps
        d_cand = (1 - z) * (1 - cand * cand)
        slope[:, :, 0], slope[:, :, 1], slope[:, :, 2] = (before - cand) * z * (1 - z), d_cand * q * r * (1 - r), d_cand * r
        back = np.ascontiguousarray(p["u"].T)
        d_u = np.empty_like(slope)
        for t in range(steps - 1, -1, -1):
            d_states[t] += d_next
            np.multiply(d_states[t][:, None], slope[t], out=d_u[t])
            d_next = d_states[t] * z[t]
            d_next += d_u[t].reshape(lanes, 3 * n) @ back
            d_next *= tape[t][0]
        d_x = d_u.copy()
        np.multiply(d_states, d_cand, out=d_x[:, :, 2])
        d_u = d_u.reshape(-1, 3 * n)
        g["u"], g["q"] = before.reshape(-1, n).T @ d_u, d_u[:, 2 * n :].sum(axis=0)
        order = np.argsort(ids.astype(np.int16 if self.words < 1 << 15 else np.int64, copy=False), axis=None, kind="stable")
        words, first = np.unique(ids.reshape(-1)[order], return_index=True)
        g["x"] = (words, np.add.reduceat(d_x.reshape(-1, 3 * n).take(order, axis=0), first, axis=0))
        return loss / total, g, h

    def train(self, stream: np.ndarray, lanes: int = 64, steps: int = 24, epochs: int = 3, rate: float = 0.01) -> list[float]:
        """Adam over windows of `steps` words; states pass from window to window and restart after an end."""
        lanes = max(1, min(lanes, len(stream) // (2 * steps)))
        length = len(stream) // lanes
        if length < 2:
            return []
        goal = stream[: lanes * length].reshape(lanes, length).T
        given = np.vstack([np.full((1, lanes), END), goal[:-1]])
        adam, losses, total = Adam(self.p), [], epochs * -(-length // steps)
        for _ in range(epochs):
            h, seen = np.zeros((lanes, self.hidden), np.float32), []
            for s in range(0, length, steps):
                loss, g, h = self.loss_and_gradient(given[s : s + steps], goal[s : s + steps], h)
                adam.move(g, rate * (1 - adam.turn / total))
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def pass_over(self, stream: np.ndarray, adam: Adam, rate: float, most_lanes: int = 512, steps: int = 24) -> None:
        """One pass over all words of the stream; long streams run in more lanes, the last words in a lane of their own."""
        lanes = max(1, min(most_lanes, len(stream) // (40 * steps)))
        length = len(stream) // lanes
        for part in (stream[: lanes * length].reshape(lanes, length).T, stream[lanes * length :].reshape(-1, 1)):
            given = np.vstack([np.full((1, part.shape[1]), END), part[:-1]])
            h = np.zeros((part.shape[1], self.hidden), np.float32)
            for s in range(0, len(part), steps):
                _, g, h = self.loss_and_gradient(given[s : s + steps], part[s : s + steps], h)
                adam.move(g, rate)

    def score(self, ids: np.ndarray, bounds: np.ndarray, lanes: int = 1024, window: int = 32) -> np.ndarray:
        """ln probability of each whole document ids[bounds[i]:bounds[i+1]], the state carried over all its windows."""
        lengths = np.diff(bounds)
        out = np.zeros(len(lengths))
        by_length = np.argsort(-lengths, kind="stable")
        for first in range(0, len(by_length), lanes):
            docs = by_length[first : first + lanes]
            size, at = lengths[docs], bounds[docs]
            h, last, total = np.zeros((len(docs), self.hidden), np.float32), np.full(len(docs), END), np.zeros(len(docs))
            for t in range(0, int(size[0]), window):
                states, goals, owners = [], [], []
                for s in range(t, min(t + window, int(size[0]))):
                    live = int(np.searchsorted(-size, -s, side="left"))
                    h = self.step(last[:live], h[:live])
                    last = ids[at[:live] + s]
                    states.append(h)
                    goals.append(last)
                    owners.append(np.arange(live))
                total += np.bincount(np.concatenate(owners), self.log_probs(np.concatenate(states), np.concatenate(goals)), len(docs))
            out[docs] = total
        return out


def _with_ones(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in that order, with a last column of ones that meets the bias."""
    out = np.ones((len(order), states.shape[1] + 1), states.dtype)
    out[:, :-1] = states.take(order, axis=0)
    return out


def _with_bias(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the bias as their last row, the largest logit that states within -1 to 1 can reach), of one softmax or of each in a stack."""
    return np.concatenate((w, b[..., None, :]), axis=-2), (np.abs(w).sum(axis=-2) + b).max(axis=-1)


def _shares(states: np.ndarray, w: np.ndarray, top: float, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each row's goal logit, exp of all logits, their sums); logits are first lowered by their row's largest where exp needs it."""
    for lowered in (False, True):
        x = states @ w
        if lowered or (top > 80 and x.max() > 80):
            x -= x.max(axis=1, keepdims=True)
        mine = x[np.arange(len(x)), goal]
        np.exp(x, out=x)
        sums = x @ np.ones(x.shape[1], x.dtype)
        if sums.min() > 1e-30:
            break
    return mine, x, sums


def _log_share(states: np.ndarray, w: np.ndarray, top: float, goal: np.ndarray) -> np.ndarray:
    """ln of the softmax share of each row's goal."""
    mine, _, sums = _shares(states, w, top, goal)
    return mine - np.log(sums)


def _share_gradient(states: np.ndarray, w: np.ndarray, top: float, goal: np.ndarray, total: int, d_states: np.ndarray, d_w: np.ndarray) -> float:
    """The loss of the rows' goals; its gradient over total is added to d_states and, with the bias's as the last row, to d_w.

    Shares stay multiplied by their row's sum; the narrow factors are divided by it instead.
    """
    mine, x, sums = _shares(states, w, top, goal)
    x[np.arange(len(x)), goal] -= sums
    part = (1 / (sums * total))[:, None]
    d_states += (x @ w[:-1].T) * part
    d_w += (states * part).T @ x
    return float((np.log(sums) - mine).sum())
