"""A gated recurrent language model in numpy: one-hot input, class-factored output softmax, truncated backpropagation, and state carried across
windows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Classes, members of each, and hidden units.
CLASSES, MEMBERS, HIDDEN = 48, 48, 16
VOCABULARY = CLASSES * MEMBERS
F32 = np.float32
#: Rows of logits that are made at a time, so that they stay in a core's cache.
ROWS = 1024
#: Sums rows of logits by a product, which is faster than a sum along short rows.
_ONES, _MEMBER_ONES = np.ones(CLASSES, F32), np.ones(MEMBERS, F32)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and member of each target, an order by class, and where each class starts in it."""
    cls = target // MEMBERS
    order = np.argsort(cls.astype(np.int16), kind="stable")  # by radix
    return cls, target - cls * MEMBERS, order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


@dataclass
class Model:
    """Parameters, all float32: `x` the gates' input by token, `u` their recurrence, `c` and `cb` the class logits, `w` and `wb` the logits within
    each class."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray

    NAMES = ("x", "u", "c", "cb", "w", "wb")
    SHAPES = ((VOCABULARY, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, MEMBERS), (CLASSES, MEMBERS))

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Model:
        """The unigram model of the counts, with small random weights before it."""
        rng = np.random.default_rng(seed)
        p = (counts.reshape(CLASSES, MEMBERS) + 0.5) / (counts.sum() + 0.5 * VOCABULARY)
        draw = lambda shape, scale: (rng.standard_normal(shape) * scale).astype(F32)
        model = cls(
            draw(cls.SHAPES[0], 0.3), draw(cls.SHAPES[1], 0.2), draw(cls.SHAPES[2], 0.05), np.log(p.sum(1)).astype(F32), draw(cls.SHAPES[4], 0.05),
            np.log(p / p.sum(1, keepdims=True)).astype(F32)
        )
        model.x[:, :HIDDEN] += 1.0  # remember at first
        return model

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        at, parts = 0, []
        for shape in cls.SHAPES:
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape).astype(F32))
            at += n
        return cls(*parts)

    def window(self, ids: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: bool = False) -> tuple:
        """Hidden states after each step of ids (steps x lanes), from h; keep is 0 where a document starts. trace: also what backpropagation needs."""
        k = HIDDEN
        gx = self.x[ids]
        out = np.empty((*ids.shape, k), F32)
        kept = tuple(np.empty((*ids.shape, n), F32) for n in (k, k, 2 * k, k)) if trace else None
        for t in range(len(ids)):
            h = h * keep[t][:, None]
            a = h @ self.u
            zr = _sigmoid(gx[t, :, : 2 * k] + a[:, : 2 * k])
            n = 2 * _sigmoid(2 * (gx[t, :, 2 * k :] + zr[:, k:] * a[:, 2 * k :])) - 1
            if trace:
                for held, value in zip(kept, (h, a[:, 2 * k :], zr, n), strict=True):
                    held[t] = value
            h = n + zr[:, :k] * (h - n)
            out[t] = h
        return (out, h, kept) if trace else (out, h)

    def log_probability(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target (any shape, flattened with its hidden states)."""
        hidden, target = hidden.reshape(-1, HIDDEN), target.ravel()
        cls, member, order, edges = _by_class(target)
        out, at = np.empty(len(target), F32), np.arange(len(target))
        for t in range(0, len(target), ROWS):
            rows = slice(t, t + ROWS)
            logits = hidden[rows] @ self.c
            logits += self.cb
            out[rows] = logits[at[: len(logits)], cls[rows]]
            out[rows] -= np.log(np.exp(logits, out=logits) @ _ONES)
        hidden, member = hidden[order], member[order]
        inner = np.empty(len(target), F32)
        for k in range(CLASSES):
            rows = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                logits = hidden[rows] @ self.w[k]
                logits += self.wb[k]
                inner[rows] = logits[at[: len(logits)], member[rows]]
                inner[rows] -= np.log(np.exp(logits, out=logits) @ _MEMBER_ONES)
        out[order] += inner
        return out


class Trainer:
    """Adagrad over windows of truncated backpropagation. seen: the sums of squares to go on from, like a model's flat()."""

    def __init__(self, model: Model, rate: float = 0.1, seen: np.ndarray | None = None):
        self.model, self.rate = model, rate
        held = Model.of(np.full(len(model.flat()), 1e-3, F32) if seen is None else seen)
        self.seen = {n: getattr(held, n) for n in Model.NAMES}

    def flat(self) -> np.ndarray:
        """The model, and after it the sums of squares."""
        return np.concatenate([self.model.flat(), *[self.seen[n].ravel() for n in Model.NAMES]])

    def _step(self, name: str, g: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[name]
        seen[at] += g * g
        getattr(self.model, name)[at] -= self.rate * g / np.sqrt(seen[at])

    def train(self, ids: np.ndarray, target: np.ndarray, keep: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window; returns the state to go on from."""
        m, k = self.model, HIDDEN
        out, last, kept = m.window(ids, keep, h, trace=True)
        scale = F32(1 / ids.shape[1])
        flat, goal = out.reshape(-1, k), target.ravel()
        cls, member, order, edges = _by_class(goal)
        p = flat @ m.c
        p += m.cb
        np.exp(p, out=p)
        p /= (p @ _ONES)[:, None]
        at = np.arange(len(goal))
        p[at, cls] -= 1
        d = p @ m.c.T
        self._step("c", flat.T @ p * scale)
        self._step("cb", p.sum(0) * scale)
        flat, member = flat[order], member[order]
        inner_d = np.empty_like(flat)
        for c in range(CLASSES):
            rows = slice(edges[c], edges[c + 1])
            if edges[c] < edges[c + 1]:
                own = flat[rows]
                p = own @ m.w[c]
                p += m.wb[c]
                np.exp(p, out=p)
                p /= (p @ _MEMBER_ONES)[:, None]
                p[at[: len(p)], member[rows]] -= 1
                inner_d[rows] = p @ m.w[c].T
                self._step("w", own.T @ p * scale, c)
                self._step("wb", p.sum(0) * scale, c)
        d[order] += inner_d
        d = d.reshape(out.shape) * scale
        before, an, zr, n = kept
        z, r = zr[..., :k], zr[..., k:]
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), an * r * (1 - r)
        back = np.zeros_like(last)
        gates, inner = np.empty((*ids.shape, 3 * k), F32), np.empty((*ids.shape, 3 * k), F32)
        for t in range(len(ids) - 1, -1, -1):
            back = back + d[t]
            dn = back * by_n[t]
            g = gates[t]
            np.multiply(back, by_z[t], out=g[:, :k])
            np.multiply(dn, by_r[t], out=g[:, k : 2 * k])
            g[:, 2 * k :] = dn
            inner[t, :, : 2 * k] = g[:, : 2 * k]
            np.multiply(dn, r[t], out=inner[t, :, 2 * k :])
            back = (back * z[t] + inner[t] @ m.u.T) * keep[t][:, None]
        gu = before.reshape(-1, k).T @ inner.reshape(-1, 3 * k)
        self._step("u", np.clip(gu, -1, 1))
        order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
        which = ids.ravel()[order]
        start = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        self._step("x", np.add.reduceat(gates.reshape(-1, 3 * k)[order], start, axis=0), which[start])
        return last


def train_on(trainer: Trainer, ids: np.ndarray, starts: np.ndarray, first: int, lanes: int = 64, steps: int = 24) -> None:
    """Trains on documents laid end to end; starts marks each one's first token, before which `first` stands. The tokens are dealt to lanes as equal
    stretches, and every token is a target once; the first lanes have one more where the tokens don't go up evenly."""
    lanes = max(1, min(lanes, len(ids) // steps))
    n, rest = divmod(len(ids), lanes)
    before = np.concatenate([[first], ids[:-1]])
    before[starts] = first
    keep = np.where(starts, F32(0), F32(1))
    lane = np.arange(lanes) * n + np.minimum(np.arange(lanes), rest)
    h = np.zeros((lanes, HIDDEN), F32)
    for t in range(0, n, steps):
        at = lane + np.arange(t, min(t + steps, n))[:, None]
        h = trainer.train(before[at], ids[at], keep[at], h)
    if rest:
        at = lane[None, :rest] + n
        trainer.train(before[at], ids[at], keep[at], h[:rest])


def score_documents(model: Model, ids: np.ndarray, bounds: np.ndarray, first: int, lanes: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each whole document ids[bounds[d]:bounds[d + 1]]. Whole documents are dealt to lanes, the longest first to the
    emptiest; a lane's state is carried from window to window and cleared where a document starts."""
    length = np.diff(bounds)
    load = [(0, k) for k in range(max(1, min(lanes, int((length > 0).sum()))))]
    own: list[list[int]] = [[] for _ in load]
    for d in np.argsort(-length, kind="stable"):
        if length[d]:
            n, k = heapq.heappop(load)
            own[k].append(int(d))
            heapq.heappush(load, (n + int(length[d]), k))
    own.sort(key=lambda docs: -sum(length[d] for d in docs))
    lane = [np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs]) if docs else np.zeros(0, np.int64) for docs in own]
    size = np.array([len(x) for x in lane])
    starts = np.zeros(len(ids), bool)
    starts[bounds[:-1][length > 0]] = True
    before = np.concatenate([[first], ids[:-1]]) if len(ids) else ids
    before[starts] = first
    out = np.zeros(len(ids))
    h = np.zeros((len(lane), HIDDEN), F32)
    for t in range(0, int(size.max(initial=0)), steps):
        live = int((size > t).sum())
        width = min(steps, int(size[0]) - t)
        at = np.full((width, live), -1)
        for k in range(live):
            part = lane[k][t : t + width]
            at[: len(part), k] = part
        real = at >= 0
        hidden, h = model.window(np.where(real, before[at], first), np.where(real & ~starts[at], F32(1), F32(0)), h[:live])
        out[at[real]] = model.log_probability(hidden[real], ids[at[real]])
    return np.concatenate([np.add.reduceat(np.append(out, 0.0), bounds[:-1]) * (length > 0)]) if len(length) else np.zeros(0)
