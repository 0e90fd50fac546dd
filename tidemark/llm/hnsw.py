"""Hierarchical navigable small-world graphs over unit vectors, in numpy.

Nodes go in by batches, and queries walk in step with each other: every step expands the best nodes
that each query's beam has not expanded, and keeps the best of what it then has.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a node above the ground layer (twice that on it), beam while building, nodes of a
#: batch, nodes that a query expands at once.
M, EF_BUILD, BATCH, STEP = 12, 32, 256, 3
#: Nodes that a search for themselves does not find get links from this many of what it finds; beam of
#: that search, and rounds of it.
LINKED, EF_SELF, ROUNDS = 4, 24, 4


class Graph:
    def __init__(self, x: np.ndarray, seed: int = 7):
        """x: unit vectors, a row each."""
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        draw = np.random.Generator(np.random.PCG64(seed)).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int), 6)
        self.layers = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        at = 0
        while at < n:
            to = min(n, at + max(16, min(BATCH, at)))
            self._insert(np.arange(at, to))
            at = to
        if n:
            self._give_links()

    def _give_links(self) -> None:
        """Links from where a search for a node ends to the node, where it is not found: groups of like
        vectors choose each other, and may be left without a link from elsewhere."""
        lost = np.arange(len(self.x))
        for _ in range(ROUNDS):
            ids, _ = self.search(self.x[lost], EF_SELF)
            away = ~(ids == lost[:, None]).any(1)
            lost, ids = lost[away], ids[away, :LINKED]
            if not len(lost):
                break
            row, col = np.nonzero(ids >= 0)
            source, target = ids[row, col], lost[row]
            order = np.argsort(source, kind="stable")
            source, target = source[order], target[order]
            _, first, count = np.unique(source, return_index=True, return_counts=True)
            more = np.full((len(self.x), int(count.max())), -1, np.int32)
            more[source, np.arange(len(source)) - np.repeat(first, count)] = target
            self.layers[0] = np.concatenate([self.layers[0], more], 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the nodes in each query's last beam; ids -1 where it is not full."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = self._descend(q, 0)
        return self._beam(q, ids, sims, self.layers[0], ef)

    def _descend(self, q: np.ndarray, to: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(q), 1), self.entry, np.int32)
        sims = (q @ self.x[self.entry])[:, None]
        for k in range(int(self.level[self.entry]), to, -1):
            ids, sims = self._beam(q, ids, sims, self.layers[k], 1)
        return ids, sims

    def _beam(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, layer: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        out = [self._beam_of(q[i : i + BATCH], ids[i : i + BATCH], sims[i : i + BATCH], layer, ef) for i in range(0, len(q), BATCH)]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _beam_of(self, q, ids, sims, layer, ef):
        b, step = len(q), min(STEP, ef)
        beam = np.full((b, ef), -1, np.int32)
        score = np.full((b, ef), -np.inf, np.float32)
        w = min(ef, ids.shape[1])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :w]
        beam[:, :w], score[:, :w] = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        done = beam < 0
        seen = np.zeros((b, len(self.x)), bool)
        rows = np.arange(b)
        np.put_along_axis(seen, np.maximum(beam, 0), True, 1)
        while len(rows):
            # the best of each beam not yet expanded; beams are sorted
            open_at = np.argsort(done[rows], axis=1, kind="stable")[:, :step]
            fresh = ~np.take_along_axis(done[rows], open_at, 1)
            live = fresh[:, 0]
            rows, open_at, fresh = rows[live], open_at[live], fresh[live]
            if not len(rows):
                break
            nodes = np.where(fresh, np.take_along_axis(beam[rows], open_at, 1), -1)
            done[rows[:, None], open_at] = True
            near = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[rows[:, None], np.maximum(near, 0)]] = -1
            at = near >= 0
            r, c = np.nonzero(at)
            new = near[at]
            seen[rows[r], new] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.x[new], q[rows[r]])
            all_ids = np.concatenate([beam[rows], near], 1)
            all_sims = np.concatenate([score[rows], s], 1)
            all_done = np.concatenate([done[rows], near < 0], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            beam[rows], score[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
            beam[rows] = np.where(np.isneginf(score[rows]), -1, beam[rows])
            done[rows] |= beam[rows] < 0
        return beam, score

    def _choose(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates: first those closer to it than to all chosen, then the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        b, c = ids.shape
        chosen, count = np.zeros((b, c), bool), np.zeros(b, int)
        nearest = np.full((b, c), -np.inf, np.float32)
        for k in range(c):
            take = (ids[:, k] >= 0) & (count < m) & (sims[:, k] > nearest[:, k])
            chosen[:, k] = take
            count += take
            nearest[take] = np.maximum(nearest[take], among[take, k])
        rank = np.where(ids < 0, 2 * c + 1, np.where(chosen, 0, c)) + np.arange(c)
        top = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(ids, top, 1)
        return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        if self.entry >= 0:
            top = int(self.level[self.entry])
            ids, sims = np.full((len(new), 1), self.entry, np.int32), (q @ self.x[self.entry])[:, None]
        for k in range(int(self.level[new].max()), -1, -1) if self.entry < 0 else range(max(top, int(self.level[new].max())), -1, -1):
            here = self.level[new] >= k
            if self.entry >= 0 and k <= top:
                ids, sims = self._beam(q, ids, sims, self.layers[k], EF_BUILD if here.any() else 1)
            if not here.any():
                continue
            mates = np.where(here[None, :], own[here], -np.inf)
            w = min(EF_BUILD, mates.shape[1])
            best = np.argpartition(-mates, w - 1, axis=1)[:, :w]
            c_sims = np.take_along_axis(mates, best, 1)
            c_ids = np.where(np.isneginf(c_sims), -1, new[best])
            if self.entry >= 0 and k <= top:
                c_ids, c_sims = np.concatenate([ids[here], c_ids], 1), np.concatenate([sims[here], c_sims], 1)
            layer = self.layers[k]
            width = layer.shape[1]
            picked = self._choose(c_ids, c_sims, M)
            layer[new[here], :M] = picked
            self._back(layer, np.repeat(new[here], M), picked.ravel(), width)
        if self.entry < 0 or self.level[new].max() > self.level[self.entry]:
            self.entry = int(new[self.level[new].argmax()])

    def _back(self, layer: np.ndarray, source: np.ndarray, target: np.ndarray, width: int) -> None:
        """Adds the links target -> source, choosing anew among each target's old and nearest new ones."""
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sims = np.einsum("ij,ij->i", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = 2 * width
        rank = np.arange(len(target)) - np.repeat(first, count)
        row = np.repeat(np.arange(len(nodes)), count)
        ids = np.full((len(nodes), most), -1, np.int32)
        ids[row[rank < most], rank[rank < most]] = source[rank < most]
        ids = np.concatenate([layer[nodes], ids], 1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        full = (ids >= 0).sum(1) > width
        keep = np.sort(np.where(ids < 0, 2**31 - 1, ids), axis=1)[:, :width]
        layer[nodes] = np.where(keep == 2**31 - 1, -1, keep)
        for at in range(0, int(full.sum()), BATCH):
            part = np.flatnonzero(full)[at : at + BATCH]
            s = np.einsum("ijk,ik->ij", self.x[np.maximum(ids[part], 0)], self.x[nodes[part]])
            layer[nodes[part]] = self._choose(ids[part], np.where(ids[part] < 0, -np.inf, s), width)
