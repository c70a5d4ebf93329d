"""A small convolutional classifier over hashed tokens, in numpy: embeddings, several filter widths, max pooling, one output."""

from __future__ import annotations

import numpy as np

from .common import ship

#: Tokens that are scored at once.
PIECE = 1 << 15


class TextCnn:
    """sizes: entries of each embedding table; a token's vector is the sum over its tables. Entry `size` is padding (zero)."""

    def __init__(self, sizes: tuple[int, ...], dim: int = 16, widths: tuple[int, ...] = (1, 2, 3), filters: int = 16, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.sizes, self.widths, self.filters = sizes, widths, filters
        self.tables = [rng.normal(0, 0.1, (s + 1, dim)).astype(np.float32) for s in sizes]
        for t in self.tables:
            t[-1] = 0
        self.kernel = rng.normal(0, 0.3, (dim, sum(widths) * filters)).astype(np.float32)
        self.bias = np.zeros(len(widths) * filters, np.float32)
        self.out = rng.normal(0, 0.3, len(widths) * filters).astype(np.float32)
        self.shift = np.float32(0)

    def slots(self, ids: list[np.ndarray], lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Tokens with padding behind each text (an empty text is one padding token), first slots, and a mask of the padding."""
        pad = max(self.widths) - 1
        room = np.maximum(lengths, 1) + pad
        starts = np.concatenate([[0], np.cumsum(room)])
        index = np.arange(len(ids[0])) + np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths)
        laid = []
        for size, x in zip(self.sizes, ids, strict=True):
            laid.append(np.full(starts[-1], size, np.int64))
            laid[-1][index] = x
        padding = np.zeros(starts[-1], bool)
        for j in range(1, pad + 1):
            padding[starts[1:] - j] = True
        return laid, starts[:-1], padding

    def responses(self, laid: list[np.ndarray], padding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector of each slot, and the response of each filter at each slot."""
        vectors = self.tables[0][laid[0]]
        for t, x in zip(self.tables[1:], laid[1:], strict=True):
            vectors += t[x]
        f, at, found = self.filters, 0, np.empty((len(vectors), len(self.bias)), np.float32)
        for i, width in enumerate(self.widths):
            s = found[:, i * f : (i + 1) * f]
            for j in range(width):  # one place at a time, to hold no more than its part
                part = vectors @ self.kernel[:, at + j * f : at + (j + 1) * f]
                if j:
                    s[:-j] += part[j:]
                else:
                    s[:] = part
            at += width * f
        found[padding] = -np.inf
        return vectors, found

    def pooled(self, ids: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """The highest response of each filter in each text."""
        laid, starts, padding = self.slots(ids, lengths)
        return np.maximum.reduceat(self.responses(laid, padding)[1], starts, axis=0)

    def pooled_long(self, ids: list[np.ndarray]) -> np.ndarray:
        """As pooled, for one text, piece by piece. A piece ends with the tokens that its last filters reach into; what starts
        there counts in the next piece, so the highest responses are those of the whole."""
        reach, best = max(self.widths) - 1, np.full(len(self.bias), -np.inf, np.float32)
        for first in range(0, len(ids[0]), PIECE):
            part = [x[first : first + PIECE + reach] for x in ids]
            laid, _, padding = self.slots(part, np.array([len(part[0])]))
            best = np.maximum(best, self.responses(laid, padding)[1][:PIECE].max(axis=0))
        return best

    def logits(self, ids: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """ids: for each table the tokens of all texts, one behind the other. Memory is bounded by PIECE tokens, whatever the texts."""
        if not len(lengths):
            return np.empty(0)
        ends = np.cumsum(lengths)
        found, first = [], 0
        while first < len(lengths):
            begin = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
            part = [x[begin : ends[last - 1]] for x in ids]
            found.append(self.pooled_long(part)[None] if lengths[first] > PIECE else self.pooled(part, lengths[first:last]))
            first = last
        return (np.maximum(np.concatenate(found) + self.bias, 0) @ self.out + self.shift).astype(np.float64)

    def fit(self, ids: list[np.ndarray], ends: np.ndarray, labels: np.ndarray, chosen_from: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.1, seed: int = 1, least: int = 1) -> None:
        """ids: for each table the tokens of all texts, one behind the other; ends: where each text ends; chosen_from: numbers of
        the texts to learn from. AdaGrad on the logistic loss; both classes weigh the same. Entries that fewer than `least` of
        the texts hold count as padding, here and later: they can't be learnt, only memorised."""
        begins = np.append(0, ends[:-1])
        for k, (t, size) in enumerate(zip(self.tables, self.sizes, strict=True)):
            held = np.zeros(size + 1, np.int64)
            for i in chosen_from:
                held[np.unique(ids[k][begins[i] : ends[i]])] += 1
            t[held < least] = 0
            ids[k] = np.where(held[ids[k]] < least, size, ids[k]).astype(np.int32)
        rng = np.random.default_rng(seed)
        share = labels[chosen_from].mean()
        weights = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        params = [self.kernel, self.bias, self.out]
        sums = [np.full_like(p, 0.01) for p in params]
        table_sums = [np.full((len(t), 1), 0.01, np.float32) for t in self.tables]
        shift_sum, f = 0.01, self.filters
        for _ in range(epochs):
            order = rng.permutation(chosen_from)
            for b in range(0, len(order), batch):
                chosen = order[b : b + batch]
                own = [np.concatenate([x[begins[i] : ends[i]] for i in chosen]) for x in ids]
                laid, starts, padding = self.slots(own, (ends - begins)[chosen])
                vectors, found = self.responses(laid, padding)
                stops = np.append(starts[1:], len(found))
                top = np.stack([a + found[a:e].argmax(axis=0) for a, e in zip(starts, stops, strict=True)])
                act = np.maximum(np.take_along_axis(found, top, axis=0) + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.shift, -30, 30)))
                g = ((p - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
                d = g[:, None] * self.out * (act > 0)
                d_kernel, rows, moves, at = np.zeros_like(self.kernel), [], [], 0
                for i, width in enumerate(self.widths):
                    part, slot = d[:, i * f : (i + 1) * f], top[:, i * f : (i + 1) * f]
                    for j in range(width):
                        cols = slice(at + j * f, at + (j + 1) * f)
                        d_kernel[:, cols] = np.einsum("bfd,bf->df", vectors[slot + j], part)
                        rows.append((slot + j).ravel())
                        moves.append((part[:, :, None] * self.kernel[:, cols].T[None]).reshape(-1, vectors.shape[1]))
                    at += width * f
                rows, moves = np.concatenate(rows), np.concatenate(moves)
                for t, s, size, x in zip(self.tables, table_sums, self.sizes, laid, strict=True):
                    entries, inverse = np.unique(x[rows], return_inverse=True)
                    total = np.zeros((len(entries), moves.shape[1]), np.float32)
                    np.add.at(total, inverse, moves)
                    total[entries == size] = 0
                    s[entries] += (total**2).mean(axis=1, keepdims=True)
                    t[entries] -= rate * total / np.sqrt(s[entries])
                for x, s, grad in zip(params, sums, (d_kernel, d.sum(axis=0), act.T @ g), strict=True):
                    s += grad**2
                    x -= (rate * grad / np.sqrt(s)).astype(np.float32)
                shift_sum += float(g.sum()) ** 2
                self.shift = np.float32(self.shift - rate * g.sum() / shift_sum**0.5)


ship(__name__)
