"""Character tagger in numpy: bidirectional LSTM, label scores, and CRF transitions between labels."""

from __future__ import annotations

import numpy as np

WIDTH = 64
KINDS = ["email", "ip", "card", "phone"]
#: Label 0 is "outside"; kind k begins with 1 + 2k and goes on with 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
SYMBOLS = 100


def encode(text: str) -> np.ndarray:
    """A small number per character: printable ASCII has its own, other letters and the rest share one each.

    Other characters are told apart by code point alone (Latin letters and above, or control), so the
    work is one array lookup.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((code >= 32) & (code < 127), code - 30, np.where(code >= 160, 97, np.where(code == 10, 98, 99))).astype(np.int64)


def allowed() -> np.ndarray:
    """Transitions that label sequences may use: a span goes on only after its own begin or middle."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_BLOCKED = np.where(allowed(), 0.0, -1e4).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights as plain arrays, so that a trained tagger travels to the tasks as it is."""

    def __init__(self, seed: int = 7, embed: int = 12, hidden: int = 16):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.w = {"embed": draw(SYMBOLS, embed) * 3, "out": draw(2 * hidden, LABELS), "bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32)}
        for d in ("f", "b"):
            start = np.zeros(4 * hidden, np.float32)
            start[hidden : 2 * hidden] = 1  # forget gates begin open
            self.w |= {f"x{d}": draw(embed, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"c{d}": start}

    # one direction; time is the first axis
    def _lstm(self, d: str, x: np.ndarray, keep: bool):
        steps, batch, h = len(x), x.shape[1], self.hidden
        pre = (x.reshape(steps * batch, -1) @ self.w[f"x{d}"]).reshape(steps, batch, 4 * h) + self.w[f"c{d}"]
        out, state = np.zeros((steps, batch, h), np.float32), np.zeros((batch, h), np.float32)
        last, saved = np.zeros((batch, h), np.float32), []
        for t in range(steps):
            z = pre[t] + last @ self.w[f"h{d}"]
            g = np.empty_like(z)
            g[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            old = state
            state = g[:, h : 2 * h] * old + g[:, :h] * g[:, 3 * h :]
            bent = np.tanh(state)
            if keep:
                saved.append((g, old, bent, last))
            last = out[t] = g[:, 2 * h : 3 * h] * bent
        return out, saved

    def _lstm_back(self, d: str, x, saved, grad, grads):
        h = self.hidden
        dz_all = np.zeros((len(x), x.shape[1], 4 * h), np.float32)
        d_last, d_state = np.zeros_like(saved[0][3]), np.zeros_like(saved[0][3])
        for t in reversed(range(len(x))):
            g, old, bent, last = saved[t]
            i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            d_out = grad[t] + d_last
            d_state = d_state + d_out * o * (1 - bent * bent)
            dz = dz_all[t]
            dz[:, :h] = d_state * c * i * (1 - i)
            dz[:, h : 2 * h] = d_state * old * f * (1 - f)
            dz[:, 2 * h : 3 * h] = d_out * bent * o * (1 - o)
            dz[:, 3 * h :] = d_state * i * (1 - c * c)
            grads[f"h{d}"] += last.T @ dz
            d_last, d_state = dz @ self.w[f"h{d}"].T, d_state * f
        flat = dz_all.reshape(-1, 4 * h)
        grads[f"x{d}"] += x.reshape(len(flat), -1).T @ flat
        grads[f"c{d}"] += flat.sum(0)
        return (flat @ self.w[f"x{d}"].T).reshape(x.shape)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Label scores ``[windows, WIDTH, LABELS]`` of encoded windows."""
        x = self.w["embed"][codes.T]
        f, _ = self._lstm("f", x, False)
        b, _ = self._lstm("b", x[::-1], False)
        return (np.concatenate([f, b[::-1]], 2) @ self.w["out"] + self.w["bias"]).transpose(1, 0, 2)

    def _loss(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the gold labels under the CRF, and its gradients."""
        n, steps = codes.shape
        x = self.w["embed"][codes.T]
        f, kept_f = self._lstm("f", x, True)
        b, kept_b = self._lstm("b", x[::-1], True)
        both = np.concatenate([f, b[::-1]], 2)
        e = both @ self.w["out"] + self.w["bias"]
        move = self.w["move"] + _BLOCKED
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, steps):
            s = ahead[t - 1][:, :, None] + move
            top = s.max(1)
            ahead[t] = top + np.log(np.exp(s - top[:, None, :]).sum(1)) + e[t]
        for t in reversed(range(steps - 1)):
            s = move + (e[t + 1] + back[t + 1])[:, None, :]
            top = s.max(2)
            back[t] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        top = ahead[-1].max(1)
        total = top + np.log(np.exp(ahead[-1] - top[:, None]).sum(1))
        y, rows = gold.T, np.arange(n)
        right = sum(e[t][rows, y[t]] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        d_e = np.exp(ahead + back - total[None, :, None])
        for t in range(steps):
            d_e[t][rows, y[t]] -= 1
        for t in range(1, steps):
            p = np.exp(ahead[t - 1][:, :, None] + move + (e[t] + back[t])[:, None, :] - total[:, None, None])
            grads["move"] += p.sum(0)
            np.subtract.at(grads["move"], (y[t - 1], y[t]), 1)
        d_e = d_e.astype(np.float32)
        flat = d_e.reshape(-1, LABELS)
        grads["out"], grads["bias"] = both.reshape(len(flat), -1).T @ flat, flat.sum(0)
        d_both = (flat @ self.w["out"].T).reshape(both.shape)
        h = self.hidden
        d_x = self._lstm_back("f", x, kept_f, d_both[:, :, :h], grads)
        d_x += self._lstm_back("b", x[::-1], kept_b, d_both[::-1, :, h:], grads)[::-1]
        np.add.at(grads["embed"], codes.T, d_x)
        return float((total - right).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, codes: np.ndarray, gold: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for epoch in range(epochs):
            order, seen = rng.permutation(len(codes)), []
            pace = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                loss, grads = self._loss(codes[pick], gold[pick])
                seen.append(loss)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * np.float32(min(1.0, 5.0 / (size + 1e-9)))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """Most probable label of every character of ``[sequences, length, LABELS]`` scores."""
        n, steps, _ = scores.shape
        move = self.w["move"] + _BLOCKED
        best, via = scores[:, 0].copy(), np.zeros((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + move
            via[t] = s.argmax(1)
            best = s.max(1) + scores[:, t]
        path = np.zeros((n, steps), np.int8)
        path[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = via[t][rows, path[:, t]]
        return path
