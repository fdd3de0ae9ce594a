"""BPE of many short words at once, in numpy.

Every round merges, in each word still open, the leftmost pair of least cost,
which is the order in which a single word's pairs merge. Long words and those
with characters outside the vocabulary go the slow way.
"""

from __future__ import annotations

import numpy as np

from moatlens.llm.pieces import LONG, SPACE, PieceModel

NONE = np.iinfo(np.int32).max


class ManyWords:
    def __init__(self, model: PieceModel):
        self.model, n = model, len(model.pieces)
        self.n = n
        rank = {c: k for k, c in enumerate(sorted(set(model.cost.values())))}
        rows = [(model.ids[p[:i]] * n + model.ids[p[i:]], rank[model.cost[p]], model.ids[p])
                for p in model.ids for i in range(1, len(p)) if p[:i] in model.ids and p[i:] in model.ids]
        rows.sort()
        self.key, self.rank, self.to = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in model.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.plain = model.dummy and model.escape and not model.squeeze and not model.map.units and model.own is None

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of every pair of symbols; NONE where they don't merge."""
        key = a * self.n + b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        ok = self.key[at] == key
        return np.where(ok, self.rank[at], NONE), self.to[at]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words, one after the other, and how many each has."""
        if not words or not self.plain or not len(self.key):
            return self._slow(words)
        text = SPACE + SPACE.join(words)
        s = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        length = np.array([len(w) + 1 for w in words])
        word = np.repeat(np.arange(len(words)), length)
        odd = np.zeros(len(words), bool)
        odd[word[s < 0]] = True
        odd |= length > LONG  # these merge through a heap
        keep = ~odd[word]
        s, word = s[keep], word[keep]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(s), NONE)
        to = np.zeros(len(s), np.int64)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], to[same] = self._pairs(s[same], s[same + 1])
        while len(s):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(first, len(s)))
            best = np.minimum.reduceat(rank, first)
            best_of = np.repeat(best, size)
            if (best == NONE).any():
                end = best_of == NONE
                done.append((word[end], s[end]))
                s, word, rank, to, best_of = s[~end], word[~end], rank[~end], to[~end], best_of[~end]
                if not len(s):
                    break
            hit = np.flatnonzero(rank == best_of)
            hit = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]
            s[hit] = to[hit]
            stay = np.ones(len(s), bool)
            stay[hit + 1] = False
            hit -= np.arange(len(hit))  # where the merged symbols are once one symbol a word is gone
            s, word, rank, to = s[stay], word[stay], rank[stay], to[stay]
            rank[hit] = NONE
            for at in (hit[(hit + 1 < len(s))], hit[hit > 0] - 1):
                at = at[word[at] == word[at + 1]]
                rank[at], to[at] = self._pairs(s[at], s[at + 1])
        if odd.any():
            which = np.flatnonzero(odd)
            ids, size = self._slow([words[i] for i in which])
            done.append((np.repeat(which, size), ids))
        word, ids = (np.concatenate([d[k] for d in done]) for k in range(2))
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def _slow(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.model.encode(w)[0] for w in words]
        return np.array([i for g in got for i in g], np.int64), np.array([len(g) for g in got], np.int64)
