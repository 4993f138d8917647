"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Small enough to train on the driver in seconds and to go out in a broadcast of fixed size. All sequences
of a batch have one length; what lies outside a text is the padding character.
"""

from __future__ import annotations

import numpy as np

#: Characters: padding, letter, digit, line end, anything else, then the signs among printable ASCII.
PAD, LETTER, DIGIT, LINE, OTHER, ASCII = 0, 1, 2, 3, 4, 5
VOCABULARY = ASCII + 95


_TABLE = np.array([LINE if c == 10 else OTHER if c < 32 or c > 126 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else c - 32 + ASCII for c in range(128)], dtype=np.int16)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = _TABLE[np.minimum(points, 127)]
    for i in np.flatnonzero(points >= 127):
        c = text[i]
        out[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters and the three passes: scores, loss with gradients, best tags."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.h, self.tags = hidden, tags
        self.p = {"out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "next": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": draw(VOCABULARY, 4 * hidden), f"back_{d}": draw(hidden, 4 * hidden), f"b_{d}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (batch, length, hidden) of one direction; gates in order in, forget, out, new."""
        n, length = x.shape
        h = c = np.zeros((n, self.h), np.float32)
        states, kept = np.empty((n, length, self.h), np.float32), []
        inside = self.p[f"in_{d}"] + self.p[f"b_{d}"]
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = inside[x[:, t]] + h @ self.p[f"back_{d}"]
            gates, new = _sigmoid(z[:, : 3 * self.h]), np.tanh(z[:, 3 * self.h :])
            i, f, o = gates[:, : self.h], gates[:, self.h : 2 * self.h], gates[:, 2 * self.h :]
            c_new = f * c + i * new
            tc = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, i, f, o, new, tc))
            h, c = o * tc, c_new
            states[:, t] = h
        return states, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        n, length = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        a, step, rows = self.p["first"].astype(np.float64), self.p["next"].astype(np.float64), np.arange(n)
        sums = lambda v, axis: (m := v.max(axis=axis, keepdims=True)) .squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = a + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = sums(alpha[:, t - 1, :, None] + step, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = sums(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = sums(alpha[:, -1], 1)
        gold = a[y[:, 0]] + e[rows[:, None], np.arange(length), y].sum(axis=1) + step[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = np.exp(alpha + beta - z[:, None, None])
        g = {"first": de[:, 0].sum(axis=0)}
        np.subtract.at(g["first"], y[:, 0], 1)
        pair = np.zeros_like(step)
        for t in range(1, length):
            pair += np.exp(alpha[:, t - 1, :, None] + step + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
        g["next"] = pair
        de[rows[:, None], np.arange(length), y] -= 1
        de = de.astype(np.float32)
        g |= {"out": np.einsum("nth,ntk->hk", both, de), "bias": de.sum(axis=(0, 1))}
        dboth = de @ self.p["out"].T
        one = np.eye(VOCABULARY, dtype=np.float32)[x]
        for k, d in enumerate("fb"):
            dstates = dboth[:, :, k * self.h : (k + 1) * self.h]
            dh = dc = np.zeros((n, self.h), np.float32)
            gi, gb = np.zeros_like(self.p[f"in_{d}"]), np.zeros_like(self.p[f"back_{d}"])
            for t, h, c, i, f, o, new, tc in reversed(runs[d][1]):
                dh = dh + dstates[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * new * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                gi += one[:, t].T @ dz
                gb += h.T @ dz
                dh, dc = dz @ self.p[f"back_{d}"].T, dc * f
            g |= {f"in_{d}": gi, f"back_{d}": gb, f"b_{d}": gi.sum(axis=0)}
        return float((z - gold).mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each round."""
        rng, m, v, t, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(rounds):
            order, total = rng.permutation(len(x)), 0.0
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                loss, g = self.loss(x[at], y[at])
                total, t = total + loss * len(at), t + 1
                for name, d in g.items():
                    d = np.clip(d, -1, 1)
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each sequence (Viterbi), and how far each tag's score lies above that of tag 0."""
        e = self.emissions(x)
        n, length, k = e.shape
        best, back = self.p["first"] + e[:, 0], np.empty((n, length, k), np.int8)
        for t in range(1, length):
            s = best[:, :, None] + self.p["next"]
            back[:, t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        margin = np.take_along_axis(e, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0] - e[:, :, 0]
        return tags, margin
