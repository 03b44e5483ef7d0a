"""A character tagger: bidirectional LSTM emissions and CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SYMBOLS = 130  # ASCII, other letters, other characters
HIDDEN = 24


def tag_of(kind: int, first: bool) -> int:
    return 1 + 2 * kind + (not first)


def symbols(text: str, length: int) -> np.ndarray:
    """Symbol numbers of ``text``, padded with spaces."""
    codes = [ord(c) if ord(c) < 128 else 128 + (not c.isalpha()) for c in text]
    return np.array(codes + [32] * (length - len(codes)), np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        small = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"out": small(2 * h, TAGS), "out0": np.zeros(TAGS, np.float32), "next": small(TAGS, TAGS)}
        for side in ("f", "b"):
            self.w[f"in_{side}"], self.w[f"rec_{side}"] = small(SYMBOLS, 4 * h), small(h, 4 * h)
            self.w[f"in_{side}"][:, h : 2 * h] += 0.5  # remember at first
        # An inside tag only follows its own kind.
        self.barred = np.zeros((TAGS, TAGS), np.float32)
        for kind in range(len(KINDS)):
            inside = tag_of(kind, False)
            self.barred[:, inside] = -1e4
            self.barred[[tag_of(kind, True), inside], inside] = 0
        self.first = np.array([0.0] + [-1e4 * (i % 2 == 0) for i in range(1, TAGS)], np.float32)

    # --- LSTM: x is (batch, time) symbols; the backward side reads time reversed ---------

    def _run(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        h_size, rec = HIDDEN, self.w[f"rec_{side}"]
        given = self.w[f"in_{side}"][x]
        h = c = np.zeros((len(x), h_size), np.float32)
        out, kept = np.empty((*x.shape, h_size), np.float32), []
        for t in range(x.shape[1]):
            z = given[:, t] + h @ rec
            s = _sigmoid(z[:, : 3 * h_size])
            i, f, o = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((i, f, o, g, tc, c_before, before))
        return out, kept

    def _back(self, side: str, x: np.ndarray, kept: list, d_out: np.ndarray, grads: dict) -> None:
        h_size, rec = HIDDEN, self.w[f"rec_{side}"]
        d_z = np.empty((*x.shape, 4 * h_size), np.float32)
        dh = dc = np.zeros((len(x), h_size), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, g, tc, c_before, _ = kept[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            d_z[:, t] = np.concatenate([
                dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g),
            ], 1)
            dc = dc * f
            dh = d_z[:, t] @ rec.T
        flat = d_z.reshape(-1, 4 * h_size)
        before = np.stack([k[6] for k in kept], 1).reshape(-1, h_size)
        one_hot = (x.reshape(-1)[:, None] == np.arange(SYMBOLS)).astype(flat.dtype)
        grads[f"rec_{side}"], grads[f"in_{side}"] = before.T @ flat, one_hot.T @ flat

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        forward, kept_f = self._run("f", x)
        backward, kept_b = self._run("b", x[:, ::-1])
        both = np.concatenate([forward, backward[:, ::-1]], 2)
        return both @ self.w["out"] + self.w["out0"], (both, kept_f, kept_b)

    # --- CRF ----------------------------------------------------------------------------

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely tags of every window (batch, time)."""
        e, _ = self.emissions(x)
        step = self.w["next"] + self.barred
        score, back = e[:, 0] + self.first, []
        for t in range(1, x.shape[1]):
            through = score[:, :, None] + step
            best = through.argmax(1)
            back.append(best)
            score = np.take_along_axis(through, best[:, None], 1)[:, 0] + e[:, t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = score.argmax(1)
        rows = np.arange(len(x))
        for t in range(x.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[t - 1][rows, tags[:, t]]
        return tags

    def _loss(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log-likelihood per window; its gradients by emissions and transitions."""
        n, length, _ = e.shape
        step = self.w["next"] + self.barred
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + self.first
        for t in range(1, length):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsum(step + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
        total = _logsum(alpha[:, -1], 1)
        d_e = np.exp(alpha + beta - total[:, None, None])
        d_next = np.zeros_like(step)
        for t in range(1, length):
            pair = alpha[:, t - 1, :, None] + step + (e[:, t] + beta[:, t])[:, None] - total[:, None, None]
            d_next += np.exp(pair).sum(0)
        rows, times = np.arange(n)[:, None], np.arange(length)
        gold = e[rows, times, y].sum(1) + step[y[:, :-1], y[:, 1:]].sum(1) + self.first[y[:, 0]]
        d_e[rows, times, y] -= 1
        np.subtract.at(d_next, (y[:, :-1], y[:, 1:]), 1)
        return float((total - gold).mean()), d_e / n, d_next / n

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.03, seed: int = 6) -> Tagger:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                bx, by = x[part], y[part]
                e, (both, kept_f, kept_b) = self.emissions(bx)
                _, d_e, d_next = self._loss(e, by)
                flat, d_flat = both.reshape(-1, both.shape[2]), d_e.reshape(-1, TAGS)
                grads = {"out": flat.T @ d_flat, "out0": d_flat.sum(0), "next": d_next}
                d_both = d_e @ self.w["out"].T
                self._back("f", bx, kept_f, d_both[:, :, :HIDDEN], grads)
                self._back("b", bx[:, ::-1], kept_b, d_both[:, ::-1, HIDDEN:], grads)
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                step += 1
                now = rate * (1 - (step - 1) / steps)
                for k, g in grads.items():
                    g = g * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    change = now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                    self.w[k] = (self.w[k] - change).astype(np.float32)
        return self


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a row of tags."""
    out, start, kind = [], -1, -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        inside = tag > 0 and tag % 2 == 0 and start >= 0 and (tag - 1) // 2 == kind
        if start >= 0 and not inside:
            out.append((start, t, kind))
            start = -1
        if tag % 2 == 1:
            start, kind = t, (tag - 1) // 2
    return out
