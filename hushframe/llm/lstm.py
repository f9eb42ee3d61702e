"""A bidirectional LSTM in numpy that gives every step of a sequence a probability."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    """Two directions of `hidden` units over inputs of `width`; a logistic output on both."""

    def __init__(self, width: int, hidden: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {}
        for side in ("f", "b"):
            self.weights[f"x{side}"] = rng.normal(0, 0.1, (width, 4 * hidden))
            self.weights[f"h{side}"] = rng.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # forget gates start open
            self.weights[f"c{side}"] = bias
        self.weights["out"] = rng.normal(0, hidden**-0.5, 2 * hidden)
        self.weights["bias"] = np.zeros(1)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """States over time (steps, sequences, hidden) and, to keep, what backpropagation needs. mask: 1 where a step is real."""
        w, n = self.weights, self.hidden
        inputs = x @ w[f"x{side}"] + w[f"c{side}"]
        h, c = np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype)
        states, kept = np.zeros((*x.shape[:2], n), x.dtype), [None] * len(x)
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ w[f"h{side}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            new = f * c + i * g
            tanh, real = np.tanh(new), mask[t][:, None]
            if keep:
                kept[t] = (h, c, i, f, o, g, tanh)
            h, c = real * (o * tanh), real * new  # padding holds a state of zero
            states[t] = h
        return states, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """x: (steps, sequences, width); mask: (steps, sequences)."""
        both = np.concatenate([self._run(x, mask, s, False)[0] for s in ("f", "b")], axis=2)
        return _sigmoid(both @ self.weights["out"] + self.weights["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over the real steps, and its gradients."""
        w, n = self.weights, self.hidden
        runs = {s: self._run(x, mask, s) for s in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ w["out"] + w["bias"])
        count = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / count
        d_out = mask * (p - y) / count
        grads = {"out": np.einsum("ts,tsh->h", d_out, both), "bias": np.array([d_out.sum()])}
        for k, side in enumerate(("f", "b")):
            d_states = d_out[:, :, None] * w["out"][k * n : (k + 1) * n]
            kept, d_h, d_c = runs[side][1], np.zeros((x.shape[1], n), x.dtype), np.zeros((x.shape[1], n), x.dtype)
            d_z, grads[f"h{side}"] = np.zeros((*x.shape[:2], 4 * n), x.dtype), np.zeros_like(w[f"h{side}"])
            for t in range(len(x) - 1, -1, -1) if side == "f" else range(len(x)):
                h, c, i, f, o, g, tanh = kept[t]
                real = mask[t][:, None]
                now = real * (d_states[t] + d_h)
                cell = real * d_c + now * o * (1 - tanh**2)
                d_z[t] = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), now * tanh * o * (1 - o), cell * i * (1 - g**2)], axis=1)
                grads[f"h{side}"] += h.T @ d_z[t]
                d_h, d_c = d_z[t] @ w[f"h{side}"].T, cell * f
            grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ d_z.reshape(-1, 4 * n)
            grads[f"c{side}"] = d_z.sum(axis=(0, 1))
        return float(loss), grads


def fit(model: BiLSTM, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
    """Train by Adam on (inputs, targets) sequences; returns the mean loss of each epoch."""
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, losses = 0, []
    for _ in range(epochs):
        order = sorted(rng.permutation(len(sequences)).tolist(), key=lambda i: len(sequences[i][0]) // 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups)
        total = 0.0
        for group in groups:
            loss, grads = model.gradients(*padded([sequences[i] for i in group]))
            total, step = total + loss, step + 1
            scale = min(1.0, 5.0 / (sum((g**2).sum() for g in grads.values()) ** 0.5 + 1e-9))
            for k, g in grads.items():
                first[k] += 0.1 * (g * scale - first[k])
                second[k] += 0.001 * ((g * scale) ** 2 - second[k])
                model.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        losses.append(total / len(groups))
    return losses


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (steps, sequences, width), mask and targets of sequences of unlike length."""
    steps = max(len(x) for x, _ in sequences)
    inputs = np.zeros((steps, len(sequences), sequences[0][0].shape[1]), np.float32)
    mask, targets = np.zeros((2, steps, len(sequences)), np.float32)
    for i, (x, y) in enumerate(sequences):
        inputs[: len(x), i], mask[: len(x), i], targets[: len(x), i] = x, 1, y
    return inputs, mask, targets
