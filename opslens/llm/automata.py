"""Weighted acyclic automata over sequences of words: built from sorted rows, united by summing weights, looked up.

Every accepted path has the same number of labels; shorter sequences end in the label 0.  Words are labelled by their
rank among the automaton's own words, from 1.  The last transition of a path carries its weight, so the weight of any
prefix is the sum of the weights below its state and states with equal futures are one state.

States are made as in the incremental construction for sorted input: once the rows have passed a prefix its future is
known, and it is closed by looking up whether a state with that future is there already.  Here all states of a depth
are closed at once in array operations, the deepest first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from opslens.llm.shingles import mix

END = 0


class Automaton:
    """``words``, and per depth the transitions of its states: bounds[state] to bounds[state + 1] of labels and targets.

    At the last depth the targets are weights.  State 0 of depth 0 is the start.
    """

    def __init__(self, words: Sequence[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, paths: np.ndarray, weights: np.ndarray, words: Sequence[bytes]) -> Automaton:
        """From distinct rows of labels in ascending order (at least one) and their weights."""
        n, depth = paths.shape
        used = np.zeros(len(words) + 1, bool)
        used[paths.ravel()] = True
        used[END] = True
        label_of = np.cumsum(used) - 1
        # starts[d]: rows at which the prefix of d labels is a new one
        new = np.zeros(n, bool)
        new[0] = True
        starts = [np.zeros(1, np.int64)]
        for d in range(depth):
            new[1:] |= paths[1:, d] != paths[:-1, d]
            starts.append(np.flatnonzero(new))
        target, levels = weights.astype(np.int64), []
        for d in range(depth - 1, -1, -1):
            label = label_of[paths[starts[d + 1], d]]
            first = np.searchsorted(starts[d + 1], starts[d])
            state, levels_d = _closed(first, label, target)
            levels.append(levels_d)
            target = state
        kept = np.flatnonzero(used[1:])
        return cls([words[i] for i in kept.tolist()], levels[::-1])

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows of labels in ascending order, and their weights."""
        state, columns = np.zeros(1, np.int64), []
        for bounds, labels, targets in self.levels:
            size = bounds[state + 1] - bounds[state]
            at = np.repeat(bounds[state] - np.cumsum(size) + size, size) + np.arange(size.sum())
            columns = [np.repeat(c, size) for c in columns] + [labels[at]]
            state = targets[at]
        return np.stack(columns, 1), state

    @classmethod
    def union(cls, parts: Sequence[Automaton]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct rows of labels in ascending order, the sums of their weights in all parts, and the words."""
        words = sorted(set().union(*(p.words for p in parts)))
        rank = {word: i for i, word in enumerate(words, 1)}
        rows, weights = [], []
        for part in parts:
            to = np.array([END, *map(rank.__getitem__, part.words)], np.int32)
            labels, weight = part.paths()
            rows.append(to[labels])
            weights.append(weight)
        return (*summed(np.concatenate(rows), np.concatenate(weights)), words)

    def weight(self, path: Sequence[bytes]) -> int | None:
        """The weight of one path of words (shorter than the depth: then ended); None if it is not accepted."""
        if not hasattr(self, "label_of"):
            self.label_of = {word: i for i, word in enumerate(self.words, 1)}
        state = 0
        labels_of_path = [self.label_of.get(word) for word in path] + [END] * (len(self.levels) - len(path))
        for (bounds, labels, targets), label in zip(self.levels, labels_of_path, strict=True):
            if label is None:
                return None
            low, high = bounds[state], bounds[state + 1]
            at = low + np.searchsorted(labels[low:high], label)
            if at == high or labels[at] != label:
                return None
            state = targets[at]
        return int(state)

    def dump(self) -> bytes:
        """The arrays one behind the other, each in the narrowest type that holds it; few bytes more for few paths."""
        text = np.frombuffer(b"".join(self.words), np.uint8)
        arrays = [text, np.array([len(w) for w in self.words], np.int64)]
        for bounds, labels, targets in self.levels:
            arrays += [np.diff(bounds), labels, targets]
        arrays = [_narrow(a) for a in arrays]
        head = np.array([[a.itemsize, len(a)] for a in arrays], "<u4")
        return b"".join([np.uint32(len(arrays)).tobytes(), head.tobytes(), *[a.tobytes() for a in arrays]])

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        arrays, at = [], 4 + 8 * count
        for width, length in np.frombuffer(data, "<u4", 2 * count, 4).reshape(count, 2).tolist():
            arrays.append(np.frombuffer(data, f"u{width}", length, at))
            at += width * length
        text, ends = arrays[0].tobytes(), np.cumsum(arrays[1].astype(np.int64)).tolist()
        words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        levels = []
        for sizes, labels, targets in zip(arrays[2::3], arrays[3::3], arrays[4::3], strict=True):
            bounds = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            levels.append((bounds, labels.astype(np.int32), targets.astype(np.int64)))
        return cls(words, levels)


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _closed(first: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The state of every prefix whose transitions begin at ``first``, and the transitions of the states.

    Equal futures are found by a hash and then compared, so different ones stay apart.
    """
    size = np.diff(np.append(first, len(label)))
    key = mix(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(target.astype(np.uint64) + np.uint64(1)))
    key = np.add.reduceat(key, first)
    _, model, state = np.unique(key, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(first)), size)
    at = first[model][state[owner]] + np.arange(len(label)) - first[owner]
    same = size == size[model][state]
    at = np.minimum(at, len(label) - 1)
    differs = (label[at] != label) | (target[at] != target)
    same &= ~np.logical_or.reduceat(differs, first)
    if not same.all():  # futures that share a hash by chance
        alone = np.flatnonzero(~same)
        state[alone] = len(model) + np.arange(len(alone))
        model = np.append(model, alone)
    count = size[model]
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[model] - bounds[:-1], count) + np.arange(bounds[-1])
    return state, (bounds, label[at].astype(np.int32), target[at])


def summed(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order with the sums of their weights."""
    order = np.lexsort(_packed(rows))
    rows, weights = rows[order], weights[order]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(weights, first) if len(first) else weights


def _packed(rows: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the rows, the most significant last, with several labels in one number where they fit."""
    bits = max(1, int(rows.max()).bit_length()) if rows.size else 1
    fit, keys = max(1, 63 // bits), []
    for a in range(0, rows.shape[1], fit):
        key = rows[:, a].astype(np.int64)
        for d in range(a + 1, min(a + fit, rows.shape[1])):
            key = (key << bits) | rows[:, d]
        keys.append(key)
    return keys[::-1]


def prefixes(rows: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first row, weight) of the distinct prefixes of each length that do not run into the end label."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for d in range(rows.shape[1]):
        new[1:] |= rows[1:, d] != rows[:-1, d]
        first = np.flatnonzero(new)
        total = np.add.reduceat(weights, first)
        real = rows[first, d] != END
        yield d + 1, first[real], total[real]
