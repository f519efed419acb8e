"""Weighted acyclic automata over numbered labels: sorted sequences, each with a count.

Sequences are rows of unsigned labels, padded by 0, which is no label. A state is a list of
arcs (label, weight, target) in order of labels; the weight of an arc is the count of the
sequence that ends with it, 0 if none does. Targets come before their sources: state 0
has no arcs and the last state is the start. States of one depth with equal arcs are one state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from feedlake.llm import bytescan


@dataclass(frozen=True)
class Automaton:
    ends: np.ndarray  # where the arcs of each state end; they begin where those before end
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences in order, each once, with the sum of its counts."""
    if len(rows) < 2:
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[starts], np.add.reduceat(counts, starts)


def build(rows: np.ndarray, counts: np.ndarray) -> Automaton:
    """The automaton of sorted, different sequences.

    A row opens the states behind its labels that it does not share with the row before it,
    and so closes those of that row. A closed state gets no more arcs and is looked up
    among the known ones. States of one depth are looked up together, the deepest first.
    """
    n, depth = rows.shape
    lengths = (rows != 0).sum(axis=1)
    differs = np.ones((n, depth), dtype=bool)
    differs[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    # The arcs of each depth: the rows that open them, and the states they leave.
    opens = [np.flatnonzero(differs[:, k] & (lengths > k)) for k in range(depth)]
    place = [np.cumsum(differs[:, k] & (lengths > k)) - 1 for k in range(depth)]
    ends, labels, weights, targets = [np.zeros(1, np.int64)], [], [], []
    n_arcs, n_states = 0, 1
    below = np.zeros(0, np.int64)  # state that each arc of the next depth leads to
    for k in range(depth - 1, -1, -1):
        at = opens[k]
        # Where an arc of this depth leads: the state of the arcs that follow it.
        target = np.zeros(len(at), dtype=np.int64)
        if k + 1 < depth and len(opens[k + 1]):
            source = place[k][opens[k + 1]]
            target[source[first_of(source)]] = below
        label, weight = rows[at, k], np.where(lengths[at] == k + 1, counts[at], 0)
        source = place[k - 1][at] if k else np.zeros(len(at), dtype=np.int64)
        begin = first_of(source)
        size = np.diff(np.append(begin, len(at)))
        keep, known = first_of_equal(label, weight, target, begin, size) if k else (np.arange(len(begin)), np.arange(len(begin)))
        arcs = np.repeat(begin[keep], size[keep]) + within(size[keep])
        labels.append(label[arcs])
        weights.append(weight[arcs])
        targets.append(target[arcs])
        ends.append(n_arcs + np.cumsum(size[keep]))
        below = n_states + known
        n_arcs, n_states = n_arcs + len(arcs), n_states + len(keep)
    return Automaton(*(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ends, labels, weights, targets)))


def first_of(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, … within each group."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def first_of_equal(label, weight, target, begin, size) -> tuple[np.ndarray, np.ndarray]:
    """One of each set of equal states, and which of these each state is.

    Arcs are compared by two 64-bit hashes of all of them, in order.
    """
    if not len(begin):
        return begin, begin
    nth = bytescan.mix(within(size).astype(np.uint64) + np.uint64(1))
    keys = []
    for salt in (bytescan.MIX_1, bytescan.MIX_2):
        arc = bytescan.mix(label.astype(np.uint64) ^ salt) + bytescan.mix(weight.astype(np.uint64) * salt + bytescan.BASE)
        arc = bytescan.mix(arc + bytescan.mix(target.astype(np.uint64) + salt) * bytescan.BASE) * nth
        keys.append(np.add.reduceat(arc, begin))
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    known = np.empty(len(begin), dtype=np.int64)
    known[order] = np.cumsum(new) - 1
    return order[new], known


def entries(automaton: Automaton, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences and their counts, those of one length together."""
    return walked(automaton, automaton, depth)


def union(automata: list[Automaton], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All sequences of all automata in order, each with the sum of its counts."""
    found = [entries(one, depth) for one in automata]
    return summed(np.concatenate([rows for rows, _ in found]), np.concatenate([counts for _, counts in found]))


def compose(asked: Automaton, counts: Automaton, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of ``asked`` that ``counts`` has too, with the counts of the latter."""
    return walked(asked, counts, depth)


def walked(left: Automaton, right: Automaton, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of both automata with the counts of the right one.

    Pairs of states are walked together from both starts on, all pairs of one depth at once: of
    the arcs of the left state go on those whose label the right state has too.
    """
    names = np.unique(right.labels)
    spans = np.repeat(np.arange(len(right.ends)), np.diff(np.append(right.begins, right.ends[-1:])))
    keys = spans * (len(names) + 1) + np.searchsorted(names, right.labels)  # ascending: by state, then by label
    begins = left.begins
    at_left, at_right = np.array([len(left.ends) - 1]), np.array([len(right.ends) - 1])
    path = np.zeros((1, depth), dtype=np.uint64)
    rows, counts = [path[:0]], [np.zeros(0, np.int64)]
    for k in range(depth):
        size = left.ends[at_left] - begins[at_left]
        arc = np.repeat(begins[at_left], size) + within(size)
        from_ = np.repeat(np.arange(len(at_left)), size)
        if not len(arc) or not len(keys):
            break
        name = np.minimum(np.searchsorted(names, left.labels[arc]), len(names) - 1)
        key = at_right[from_] * (len(names) + 1) + name
        other = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = (keys[other] == key) & (names[name] == left.labels[arc])
        arc, other, from_ = arc[same], other[same], from_[same]
        path = path[from_]
        path[:, k] = left.labels[arc]
        whole = (left.weights[arc] > 0) & (right.weights[other] > 0)
        rows.append(path[whole])
        counts.append(right.weights[other[whole]])
        at_left, at_right = left.targets[arc], right.targets[other]
    return np.concatenate(rows), np.concatenate(counts)
