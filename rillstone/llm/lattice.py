"""Best segmentations of many short words at once, with numpy.

Words stand one behind the other in a buffer, each followed by a zero byte.  For
each start position, all words walk down the trie of pieces together, and each
piece that they meet offers its end position a score, so that Python's work is in
proportion to the longest word and not to the number of words.
"""

from __future__ import annotations

import numpy as np

NONE = -1e300
#: Length in bytes of the character that begins with a byte (0: none begins).
CHAR = np.zeros(256, np.int64)
CHAR[:0x80], CHAR[0xC0:0xE0], CHAR[0xE0:0xF0], CHAR[0xF0:0xF8] = 1, 2, 3, 4


class Lattice:
    """A byte trie of pieces (text: (id, score)) in an open-addressed table, and byte pieces for all other characters."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_of: list[int], unknown: float):
        children: dict[int, int] = {}
        ends: list[tuple[int, float]] = [(-1, NONE)]
        for text, (piece, score) in pieces.items():
            node = 0
            for b in text.encode():
                key = node << 8 | b
                if key not in children:
                    children[key] = len(ends)
                    ends.append((-1, NONE))
                node = children[key]
            ends[node] = (piece, score)
        self.ids = np.array([i for i, _ in ends], np.int32)
        self.scores = np.array([s for _, s in ends])
        self.shift = 64 - max(10, (4 * len(children)).bit_length())
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.child = np.full(len(self.keys), -1, np.int32)
        keys, to = np.array(list(children), np.int64), np.array(list(children.values()), np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last is written
            done = self.keys[at] == keys
            self.child[at[done]] = to[done]
            keys, to, at = keys[~done], to[~done], (at[~done] + 1) & (len(self.keys) - 1)
        self.bytes_of, self.unknown = np.array(bytes_of, np.int32), unknown

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, nodes: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, or -1."""
        keys = (nodes.astype(np.int64) << 8) | by
        at = self._slot(keys)
        found = self.keys[at]
        out = self.child[at]
        out[found != keys] = -1
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.child[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def best(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, how many by word, scores, what each word's second best loses (over 1e290 if there is none)).

        As in the search of one word, the second best leaves the best path once, so
        it loses the least difference between the two best ways into a place on that path.
        """
        buf = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        lens = np.array([len(w) for w in words], np.int64)
        base = np.zeros(len(words), np.int64)
        np.cumsum(lens[:-1] + 1, out=base[1:])
        order = np.argsort(-lens, kind="stable")
        by_length, longest_first = base[order], -lens[order]
        top, second = np.full(len(buf), NONE), np.full(len(buf), NONE)
        came, piece = np.zeros(len(buf), np.int32), np.zeros(len(buf), np.int32)
        top[base] = 0.0

        def offer(to: np.ndarray, s: np.ndarray, size: int, ids: np.ndarray) -> None:
            had = top[to]
            better = s > had
            second[to] = np.where(better, had, np.maximum(second[to], s))
            to = to[better]
            top[to], came[to], piece[to] = s[better], size, ids[better]

        for i in range(int(lens.max(initial=0))):
            at = by_length[: int(np.searchsorted(longest_first, -i, side="left"))] + i
            at = at[CHAR[buf[at]] > 0]
            own, wide = top[at], CHAR[buf[at]]
            spelled = np.ones(len(at), bool)
            active, node, size = np.arange(len(at)), np.zeros(len(at), np.int32), 0
            while len(active):
                node = self.step(node, buf[at[active] + size])
                size += 1
                go = node >= 0
                active, node = active[go], node[go]
                ends = np.flatnonzero(self.ids[node] >= 0)
                if len(ends):
                    a = active[ends]
                    spelled[a[wide[a] == size]] = False
                    offer(at[a] + size, own[a] + self.scores[node[ends]], size, self.ids[node[ends]])
            at, own, wide = at[spelled], own[spelled], wide[spelled]
            if len(at):  # characters without a piece: one byte piece after the other
                for k in range(1, int(wide.max())):
                    inner = at[wide > k] + k
                    came[inner], piece[inner] = 1, self.bytes_of[buf[inner - 1]]
                offer(at + wide, own + self.unknown * wide, 1, self.bytes_of[buf[at + wide - 1]])

        which, at = np.flatnonzero(lens), (base + lens)[lens > 0]
        score, loss = np.where(lens > 0, top[base + lens], 0.0), np.full(len(words), 1e299)
        owners, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        count = np.zeros(len(words), np.int64)
        while len(which):
            real = top[at] > NONE / 2  # not between the bytes of a character
            loss[which[real]] = np.minimum(loss[which[real]], top[at[real]] - second[at[real]])
            owners.append(which)
            ids.append(piece[at])
            count[which] += 1
            at = at - came[at]
            more = at > base[which]
            which, at = which[more], at[more]
        end = np.cumsum(count)
        flat, back = np.zeros(int(end[-1]) if len(end) else 0, np.int32), end.copy()
        for w, x in zip(owners, ids):
            back[w] -= 1
            flat[back[w]] = x
        return flat, count, score, loss
