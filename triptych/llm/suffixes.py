"""Deep-shallow sorting of strings of one width, in NumPy.

Multikey quicksort orders the strings by their first bytes; groups that agree in all of them share a
long prefix and are ordered by a blind trie, which looks at one byte for each branch and compares a
string in full only once.
"""

from __future__ import annotations

import numpy as np

# Bytes that multikey quicksort looks at, eight at a time.
SHALLOW = 16
# Subsets of this size are ordered by their words at once.
SMALL = 2048


def equal_strings(lead: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows with equal `lead` and equal bytes; in sorted order."""
    shallow = np.zeros((len(strings), SHALLOW), dtype=np.uint8)
    width = min(SHALLOW, strings.shape[1])
    shallow[:, :width] = strings[:, :width]
    words = [lead.astype(np.uint64), *shallow.view(">u8").astype(np.uint64).T]
    order = multikey_order(words)
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    # Most groups hold one string only: then none differs from the first of its group.
    odd = (strings[order] != strings[order[starts]][group]).any(axis=1)
    mixed = np.unique(group[odd])
    place = np.zeros(len(order), dtype=np.int64)
    ends = np.append(starts[1:], len(order))
    for g in mixed:
        rows = order[starts[g] : ends[g]]
        trie = BlindTrie([strings[r].tobytes() for r in rows])
        place[starts[g] : ends[g]] = trie.ranks()
    split = np.zeros(len(order), dtype=np.int64)
    # Numbers of a mixed group follow each other, so that all numbers stay in order.
    extra = np.zeros(len(starts) + 1, dtype=np.int64)
    for g in mixed:
        extra[g + 1] = place[starts[g] : ends[g]].max()
    split[order] = group + np.cumsum(extra)[:-1][group] + place if len(order) else 0
    return split


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Row numbers in the order of the words, by three-way partition around one pivot at a time."""
    done: list[np.ndarray] = []
    todo = [(np.arange(len(words[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= SMALL or depth == len(words):
            done.append(rows[np.lexsort([w[rows] for w in reversed(words[depth:])])] if depth < len(words) else rows)
            continue
        word = words[depth][rows]
        pivot = np.partition(word[:: max(1, len(word) // 1001)], min(500, len(word) // 2))[min(500, len(word) // 2)]
        todo.append((rows[word > pivot], depth))
        todo.append((rows[word == pivot], depth + 1))
        todo.append((rows[word < pivot], depth))
    return np.concatenate(done) if done else np.zeros(0, dtype=np.int64)


class BlindTrie:
    """Strings of one width; a node is [depth, {byte: node or string}], a leaf holds equal strings."""

    def __init__(self, strings: list[bytes]):
        self.leaf_of: list[bytes] = strings
        self.root: list | bytes = strings[0]
        for s in strings[1:]:
            self._insert(s)

    def _insert(self, s: bytes) -> None:
        path, node = [], self.root
        while isinstance(node, list):
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        common = next((i for i, (a, b) in enumerate(zip(s, node)) if a != b), None)
        if common is None:
            return
        above = [n for n in path if n[0] < common]
        below = path[len(above)] if len(path) > len(above) else node
        if isinstance(below, list) and below[0] == common:
            below[1][s[common]] = s
            return
        branch = [common, {node[common]: below, s[common]: s}]
        if above:
            above[-1][1][s[above[-1][0]]] = branch
        else:
            self.root = branch

    def ranks(self) -> list[int]:
        """For each string, how many smaller different ones there are."""
        found, todo = {}, [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                found[node] = len(found)
        return [found[s] for s in self.leaf_of]
