"""A small convolutional text classifier in numpy: embeddings, several filter widths, max pooling, softmax.

A token has one or several features; its embedding is the sum of theirs. Training works on the patches
under each filter; a maximum passes its gradient to one patch only, so the backward pass is cheap.
Prediction uses that an embedding followed by a filter is one table per filter column
(``embedding @ filter[j]``): a position's activations are sums of table rows, without any matrix
product. Sequences of any length are pooled whole, in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Positions whose activations are held at once.
BLOCK = 1 << 15
#: Features whose embeddings are held at once; a token with more of them is summed by counting.
FEATURES = 1 << 18


@dataclass
class TextCnn:
    """Features are 0..vocab-1; feature ``vocab`` is padding with a zero embedding."""

    vocab: int
    classes: int
    dim: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (2, 3, 4)
    seed: int = 42
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            self.weights = {"emb": draw(self.vocab + 1, self.dim, scale=0.3)}
            for w in self.widths:
                self.weights[f"conv{w}"] = draw(w * self.dim, self.filters, scale=(w * self.dim) ** -0.5)
                self.weights[f"bias{w}"] = np.zeros(self.filters, np.float32)
            self.weights["out"] = draw(len(self.widths) * self.filters, self.classes, scale=0.1)
            self.weights["out_bias"] = np.zeros(self.classes, np.float32)
            self.weights["emb"][self.vocab] = 0

    def fit(
        self,
        sequences: list[np.ndarray],
        labels: np.ndarray,
        features: np.ndarray | list[np.ndarray],
        epochs: int = 6,
        batch: int = 32,
        rate: float = 3e-3,
        class_weight: np.ndarray | None = None,
    ) -> TextCnn:
        """Adam on the cross entropy; batches of like lengths in an order drawn from the seed.

        ``sequences`` hold tokens, ``features[token]`` the features of a token, filled up with padding or
        (in a list) as many as it has.
        """
        if isinstance(features, list):
            features = [*features, np.array([self.vocab])]
        else:
            features = np.concatenate([features, np.full((1, features.shape[1]), self.vocab)])
        rng = np.random.default_rng(self.seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        by_length = np.argsort([len(s) for s in sequences], kind="stable")
        batches, step = [by_length[i : i + batch] for i in range(0, len(by_length), batch)], 0
        scale = np.ones(self.classes, np.float32) if class_weight is None else class_weight.astype(np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, step = batches[k], step + 1
                grads = self._gradients([sequences[i] for i in rows], labels[rows], features, scale)
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.weights[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.weights["emb"][self.vocab] = 0
        return self

    def _gradients(self, sequences: list[np.ndarray], labels: np.ndarray, features: np.ndarray | list[np.ndarray], scale: np.ndarray) -> dict[str, np.ndarray]:
        p, most = self.weights, max(1, *(len(s) for s in sequences))
        ids = np.full((len(sequences), most + max(self.widths) - 1), len(features) - 1, np.int64)
        for i, s in enumerate(sequences):
            ids[i, : len(s)] = s
        used, ids = np.unique(ids, return_inverse=True)
        ids, own = ids.reshape(len(sequences), -1), [features[i] for i in used]
        tokens = self._embeddings(own)
        real = np.arange(most)[None, :] < np.array([len(s) for s in sequences])[:, None]
        emb, rows, pooled, kept = tokens[ids], np.arange(len(sequences))[:, None], [], []
        for w in self.widths:
            act = p[f"bias{w}"] + sum(emb[:, j : j + most] @ p[f"conv{w}"][j * self.dim : (j + 1) * self.dim] for j in range(w))
            act = np.where(real[:, :, None], act, 0)
            at = act.argmax(axis=1)
            pooled.append(np.maximum(act[rows, at, np.arange(self.filters)], 0))
            kept.append(at)
        h = np.concatenate(pooled, axis=1)
        probs = _softmax(h @ p["out"] + p["out_bias"])
        probs[np.arange(len(labels)), labels] -= 1
        d = probs * scale[labels][:, None] / len(labels)
        grads, back = {"out": h.T @ d, "out_bias": d.sum(axis=0), "emb": np.zeros_like(p["emb"])}, np.zeros_like(tokens)
        dh = (d @ p["out"].T) * (h > 0)
        for k, (w, at) in enumerate(zip(self.widths, kept)):
            g = dh[:, k * self.filters : (k + 1) * self.filters]
            patch = ids[rows[:, :, None], at[:, :, None] + np.arange(w)]  # row, filter, offset
            grads[f"bias{w}"] = g.sum(axis=0)
            grads[f"conv{w}"] = np.einsum("bfk,bf->kf", tokens[patch].reshape(*at.shape, -1), g)
            np.add.at(back, patch.ravel(), (g[:, :, None] * p[f"conv{w}"].T[None]).reshape(-1, self.dim))
        moved = np.flatnonzero(back.any(axis=1))
        if len(moved):
            np.add.at(grads["emb"], np.concatenate([own[i] for i in moved]), np.repeat(back[moved], [len(own[i]) for i in moved], axis=0))
        return {k: v.astype(np.float32) for k, v in grads.items()}

    def table(self, features: np.ndarray) -> np.ndarray:
        """What tokens with these features add to each filter at each offset: (tokens, columns)."""
        p, d = self.weights, self.dim
        columns = [p[f"conv{w}"][j * d : (j + 1) * d] for w in self.widths for j in range(w)]
        return p["emb"][features].sum(axis=1) @ np.concatenate(columns, axis=1)

    def ragged_table(self, features: list[np.ndarray]) -> np.ndarray:
        """``table`` of tokens that have one feature or more, each its own number."""
        p, d = self.weights, self.dim
        columns = [p[f"conv{w}"][j * d : (j + 1) * d] for w in self.widths for j in range(w)]
        return self._embeddings(features) @ np.concatenate(columns, axis=1)

    def _embeddings(self, features: list[np.ndarray]) -> np.ndarray:
        """The sum of the embeddings of each token's features, a bounded number of them at a time."""
        emb = self.weights["emb"]
        out, sizes, at = np.zeros((len(features), self.dim), emb.dtype), [len(f) for f in features], 0
        while at < len(features):
            end, total = at + 1, sizes[at]
            while end < len(features) and total + sizes[end] <= FEATURES:
                total, end = total + sizes[end], end + 1
            if total > FEATURES:
                out[at] = np.bincount(features[at], minlength=self.vocab + 1) @ emb
            else:
                starts = np.concatenate(([0], np.cumsum(sizes[at : end - 1]))).astype(np.int64)
                out[at:end] = np.add.reduceat(emb[np.concatenate(features[at:end])], starts, axis=0)
            at = end
        return out

    def predict(self, ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Class probabilities of sequences laid end to end in ``ids``; an empty one has only the bias.

        ``ids`` are rows of ``table``, whose last row must be zero (padding).
        """
        f, offsets = self.filters, np.cumsum([0, *self.widths[:-1]])
        tail, n = max(self.widths) - 1, len(lengths)
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + tail))) if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), lengths)
        where = np.arange(len(ids)) + owner * tail  # padding after each sequence
        padded = np.full(int(lengths.sum()) + n * tail, len(table) - 1, np.int64)
        padded[where] = ids
        pooled = np.zeros((n, len(self.widths) * self.filters), np.float32)
        for at in range(0, len(ids), BLOCK):
            pos, own = where[at : at + BLOCK], owner[at : at + BLOCK]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for k, w in enumerate(self.widths):
                at_0 = offsets[k] * f
                act = table[padded[pos], at_0 : at_0 + f]
                for j in range(1, w):
                    act += table[padded[pos + j], at_0 + j * f : at_0 + (j + 1) * f]
                best = np.maximum.reduceat(act, first, axis=0) + self.weights[f"bias{w}"]
                into = pooled[own[first], k * f : (k + 1) * f]
                pooled[own[first], k * f : (k + 1) * f] = np.maximum(into, best)
        return _softmax(pooled @ self.weights["out"] + self.weights["out_bias"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
