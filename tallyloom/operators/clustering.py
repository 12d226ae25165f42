"""Staged average-linkage clustering of the tasks of a group.

Linkage is sequential, so a group is clustered in one task; groups run in parallel. The dendrogram is built once and cut at every threshold.
A group of up to `max_items` has a matrix of distances. A larger one is held as its unit vectors only: mean distances between
clusters, within one, and from an item to a cluster are all 1 less dot products of sums of unit vectors, so memory grows with the
number of items, and time as its square. Both give the same clusters, unless distances between other than copies are equal.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds 0.45 to 0.84, and the limits of the stages.
THRESHOLDS = tuple(round(0.45 + 0.01 * k, 2) for k in range(40))


@dataclass(frozen=True)
class ClusterParams:
    split_above: float = 0.39
    singles_share: float = 0.2
    loose_above: float = 0.65
    tight_below: float = 0.5
    #: Items of a group that has its distances as a matrix.
    max_items: int = 5000


def linkage(dist: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, a, b) of average linkage; of equal distances the pair of lowest places merges first. The merged
    cluster keeps a's place."""
    d = dist.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, out = np.ones(n), np.ones(n, dtype=bool), []
    # The nearest of each row, the lowest of equal ones; a merge changes few of them, so the whole takes about n^2 steps.
    near = d.argmin(axis=1) if n else np.empty(0, dtype=int)
    least = d[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(least))
        a, b = sorted((a, int(near[a])))
        out.append((float(d[a, b]), a, b))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        lost = (near == a) | (near == b)
        closer = ~lost & ((row < least) | ((row == least) & (a < near)))
        near[closer], least[closer] = a, row[closer]
        again = np.flatnonzero(lost & alive)
        again = np.append(again[again != a], a)
        near[again] = d[again].argmin(axis=1)
        least[again] = d[again, near[again]]
        least[b] = np.inf
    return out


def cut(merges: list[tuple[float, int, int]], n: int, threshold: float) -> np.ndarray:
    """Labels 0, 1, ... by first member; merges below the threshold hold."""
    root = list(range(n))
    for height, a, b in reversed(merges):  # where a went later is known when b, which goes once, joins it
        if height < threshold:
            root[b] = root[a]
    order = {r: k for k, r in enumerate(dict.fromkeys(root))}
    return np.array([order[r] for r in root])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    k = labels.max() + 1
    sums = np.stack([dist[:, labels == c].sum(axis=1) for c in range(k)], axis=1)
    sizes = np.bincount(labels, minlength=k)
    own = sizes[labels]
    at = np.arange(len(labels))
    a = sums[at, labels] / np.maximum(own - 1, 1)
    means = sums / sizes
    means[at, labels] = np.inf
    b = means.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def spread(dist: np.ndarray) -> float:
    """Mean distance of the pairs; 0 for one member."""
    return float(dist[np.triu_indices(len(dist), 1)].mean()) if len(dist) > 1 else 0.0


def best_cut(dist: np.ndarray) -> np.ndarray:
    """Stage 1: the cut with 2 to n/2 clusters and the best silhouette, the first of equal ones; one cluster if there is none."""
    n, best, last, labels = len(dist), -2.0, 0, np.zeros(len(dist), dtype=int)
    merges = linkage(dist)
    for th in THRESHOLDS:
        got = cut(merges, n, th)
        k = got.max() + 1
        if 1 < k <= n // 2 and k != last and (s := silhouette(dist, got)) > best:  # as many clusters: the same cut
            best, labels = s, got
        last = k
    return labels


def _parts(items: list[int], labels: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(labels.max() + 1)]
    for x, k in zip(items, labels.tolist()):
        out[k].append(x)
    return out


def resplit(items: list[int], dist: np.ndarray) -> list[list[int]]:
    """Stage 2: two or three parts of a loose cluster."""
    if len(items) == 2:
        return [[items[0]], [items[1]]]
    if len(items) == 3:
        return [items[:2], items[2:]]
    d = dist[np.ix_(items, items)]
    merges, found = linkage(d), {}
    for th in THRESHOLDS:
        got = cut(merges, len(items), th)
        k = got.max() + 1
        if k in (2, 3):
            s = silhouette(d, got)
            if k not in found or s > found[k][0] or np.isclose(s, found[k][0]):
                found[k] = (s, got)
    if not found:
        half = len(items) // 2
        return [items[:half], items[half:]]
    k = 3 if 3 in found and (2 not in found or found[3][0] >= found[2][0]) else 2
    return _parts(items, found[k][1])


def tighten(items: list[int], dist: np.ndarray, limit: float) -> list[list[int]]:
    """Stage 4: the fewest clusters whose mean cohesion is within the limit."""
    d = dist[np.ix_(items, items)]
    merges = linkage(d)
    for k in range(2, len(items) + 1):
        parts = _parts(list(range(len(items))), _cut_to(merges, len(items), k))
        if sum(spread(d[np.ix_(p, p)]) for p in parts) / len(parts) <= limit:
            return [[items[x] for x in p] for p in parts]
    return [[x] for x in items]


def _cut_to(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    return cut([(0.0, a, b) for _, a, b in merges[: n - k]], n, 1.0)


def cluster(dist: np.ndarray, p: ClusterParams = ClusterParams()) -> np.ndarray:
    """Labels of all items after the four stages; every item has one."""
    n = len(dist)
    if n < 2:
        return np.zeros(n, dtype=int)
    inner = lambda x: spread(dist[np.ix_(x, x)])
    queue, final = _parts(list(range(n)), best_cut(dist)), []
    while queue:
        items = queue.pop(0)
        if len(items) > 1 and inner(items) > p.split_above:
            queue += resplit(items, dist)
        else:
            final.append(items)
    singles = [x[0] for x in final if len(x) == 1]
    if len(singles) / n >= p.singles_share and len(singles) > 1:
        again = _parts(singles, best_cut(dist[np.ix_(singles, singles)]))
        final = [x for x in final if len(x) > 1] + again
    done, loose = [x for x in final if inner(x) <= p.loose_above], [x for x in final if inner(x) > p.loose_above]
    new = []
    while loose:
        items = loose.pop(0)
        if inner(items) <= p.tight_below:
            new.append(items)
            continue
        for part in tighten(items, dist, p.tight_below):
            (loose if inner(part) > p.tight_below and len(part) < len(items) else new).append(part)
    labels = np.zeros(n, dtype=int)
    for k, items in enumerate([*new, *done]):
        labels[items] = k
    return labels


def distances(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return np.clip(1 - v @ v.T, 0, None)


#: Items of a group that shares a task with few others.
LARGE = 1000
#: Clusters beyond which nearest ones are asked in rounds, as long as one of so many clusters merges in a round.
ROUNDS_ABOVE, ROUND_SHARE = 64, 32


def _nearest(mean: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The other row of largest product of each asked row, and that product."""
    near, most = np.zeros(len(asked), dtype=int), np.zeros(len(asked))
    step = max(16, (4 << 20) // max(1, len(mean)))
    for x in range(0, len(asked), step):
        rows = asked[x : x + step]
        at = np.arange(len(rows))
        sim = mean[rows] @ mean.T
        sim[at, rows] = -np.inf
        near[x : x + step] = to = sim.argmax(axis=1)
        most[x : x + step] = sim[at, to]
    return near, most


class Vectors:
    """The same stages over unit vectors, without their distances."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def linkage(self, items: np.ndarray) -> list[tuple[float, int, int]]:
        """Merges as linkage() gives them. Copies merge first. Then, as long as these are many, all pairs that are each other's nearest merge at
        once, and nearest ones are products of blocks, asked again of new clusters and those whose nearest has merged. The rest
        goes by chains of nearest neighbours: each link is nearer than the one before, the last two are each other's nearest and merge."""
        n, v = len(items), self.v[items]
        out: list[tuple[float, int, int]] = []
        first: dict[bytes, int] = {}
        size = np.ones(n)
        for i in range(n):
            k = v[i].tobytes()
            if v[i].any() and first.setdefault(k, i) != i:
                out.append((0.0, first[k], i))
                size[first[k]] += 1
                size[i] = 0
        live = np.flatnonzero(size)
        name, size = live.copy(), size[live]
        mean = v[live]  # of each cluster; cluster k is in row k until rows are closed up
        height = np.zeros(len(live))
        near, sim = _nearest(mean, np.arange(len(live) if len(live) > ROUNDS_ABOVE else 0))
        while len(mean) > ROUNDS_ABOVE:
            here = np.arange(len(mean))
            a = np.flatnonzero((near[near] == here) & (here < near))
            if len(a) * ROUND_SHARE < len(mean):
                break
            b = near[a]
            h = np.maximum(np.maximum(0.0, 1 - sim[a]), np.maximum(height[a], height[b]))
            a, b = np.where(name[a] < name[b], a, b), np.where(name[a] < name[b], b, a)
            out += zip(h.tolist(), name[a].tolist(), name[b].tolist())
            mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / (size[a] + size[b])[:, None]
            size[a] += size[b]
            height[a] = h
            again, keep = np.zeros(len(mean), dtype=bool), np.ones(len(mean), dtype=bool)
            again[a], keep[b] = True, False
            again = (again | again[near] | ~keep[near])[keep]
            near = (np.cumsum(keep) - 1)[near[keep]]
            mean, size, height, name, sim = mean[keep], size[keep], height[keep], name[keep], sim[keep]
            again = np.flatnonzero(again)
            near[again], sim[again] = _nearest(mean, again)
        alive = np.ones(len(mean), dtype=bool)
        chain: list[int] = []
        left, at = len(mean), 0
        while left > 1:
            if not chain:
                while not alive[at]:
                    at += 1
                chain.append(at)
            a = chain[-1]
            sim = mean @ mean[a]
            sim[~alive] = -np.inf
            sim[a] = -np.inf
            b = int(sim.argmax())
            if len(chain) > 1 and sim[chain[-2]] >= sim[b]:
                b = chain[-2]
                chain = chain[:-2]
                h = max(0.0, 1 - float(sim[b]), height[a], height[b])
                a, b = (a, b) if name[a] < name[b] else (b, a)
                out.append((h, int(name[a]), int(name[b])))
                mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
                size[a] += size[b]
                height[a], alive[b] = h, False
                left -= 1
                if left * 2 < len(alive):  # close up
                    keep = np.flatnonzero(alive)
                    to = np.cumsum(alive) - 1
                    chain, at = [int(to[c]) for c in chain], 0
                    mean, size, height, name, alive = mean[keep], size[keep], height[keep], name[keep], np.ones(left, dtype=bool)
            else:
                chain.append(b)
        return sorted(out, key=lambda m: m[0])  # stable, and no part is higher than what it is in

    def spread(self, items: list[int]) -> float:
        n = len(items)
        if n < 2:
            return 0.0
        v = self.v[items]
        total, own = v.sum(axis=0), float((v * v).sum())
        return max(0.0, 1 - (float(total @ total) - own) / (n * (n - 1)))

    def silhouette(self, items: np.ndarray, labels: np.ndarray, near: dict[str, np.ndarray] | None = None) -> float:
        """near, empty at first, keeps each item's nearest other cluster from a cut to a coarser one: a cluster that has not merged stays the
        nearest, as no merge brings anything closer. Items that are clusters by themselves have none."""
        v, k = self.v[items], labels.max() + 1
        order = np.argsort(labels, kind="stable")
        sizes = np.bincount(labels, minlength=k)
        first = np.cumsum(sizes) - sizes
        means, heads = np.add.reduceat(v[order], first, axis=0) / sizes[:, None], order[first]
        near = {} if near is None else near
        if not near:
            near.update(head=np.full(len(v), -1), size=np.zeros(len(v), dtype=int), sim=np.zeros(len(v)))
        own, of = sizes[labels], labels[near["head"]]
        ask = np.flatnonzero((own > 1) & ((heads[of] != near["head"]) | (sizes[of] != near["size"])))
        for x in range(0, len(ask), 256):
            rows = ask[x : x + 256]
            sim = v[rows] @ means.T
            sim[np.arange(len(rows)), labels[rows]] = -np.inf
            to = sim.argmax(axis=1)
            near["head"][rows], near["size"][rows], near["sim"][rows] = heads[to], sizes[to], sim[np.arange(len(rows)), to]
        use = np.flatnonzero(own > 1)
        v, c, own = v[use], labels[use], own[use]
        a = np.maximum(1 - ((v * means[c]).sum(axis=1) * own - (v * v).sum(axis=1)) / (own - 1), 0)
        b = np.maximum(1 - near["sim"][use], 0)
        return float(((b - a) / np.maximum(np.maximum(a, b), 1e-300)).sum()) / len(items)

    def best_cut(self, items: np.ndarray) -> np.ndarray:
        n, best, last, labels = len(items), -2.0, 0, np.zeros(len(items), dtype=int)
        merges, near = self.linkage(items), {}
        for th in THRESHOLDS:
            got = cut(merges, n, th)
            k = got.max() + 1
            if 1 < k <= n // 2 and k != last and (s := self.silhouette(items, got, near)) > best:
                best, labels = s, got
            last = k
        return labels

    def resplit(self, items: list[int]) -> list[list[int]]:
        if len(items) == 2:
            return [[items[0]], [items[1]]]
        if len(items) == 3:
            return [items[:2], items[2:]]
        at = np.array(items)
        merges, found = self.linkage(at), {}
        tops = [h for h, _, _ in merges[-3:]]  # two or three clusters are left between the last heights only
        for th in THRESHOLDS:
            if tops[0] < th <= tops[-1]:
                got = cut(merges, len(items), th)
                k = got.max() + 1
                if k in (2, 3):
                    s = self.silhouette(at, got)
                    if k not in found or s > found[k][0] or np.isclose(s, found[k][0]):
                        found[k] = (s, got)
        if not found:
            half = len(items) // 2
            return [items[:half], items[half:]]
        k = 3 if 3 in found and (2 not in found or found[3][0] >= found[2][0]) else 2
        return _parts(items, found[k][1])

    def tighten(self, items: list[int], limit: float) -> list[list[int]]:
        """From one cluster on the merges are undone one by one, and the mean of the spreads goes along."""
        merges = self.linkage(np.array(items))
        n = len(items)
        # Sums, numbers and squares of all clusters of the tree, bottom up.
        total, size, own, steps = self.v[items].copy(), np.ones(n), (self.v[items] ** 2).sum(axis=1), []
        value = lambda s, m, q: max(0.0, 1 - (float(s @ s) - q) / (m * (m - 1))) if m > 1 else 0.0
        now = np.zeros(n)
        for _, a, b in merges:
            before = now[a] + now[b]
            total[a] += total[b]
            size[a] += size[b]
            own[a] += own[b]
            now[a] = value(total[a], size[a], own[a])
            steps.append(before - now[a])
        mean = now[merges[-1][1]]
        for k in range(2, n + 1):
            mean += steps[n - k]
            if mean / k <= limit:
                return _parts(items, _cut_to(merges, n, k))
        return [[x] for x in items]

    def cluster(self, p: ClusterParams) -> np.ndarray:
        n = len(self.v)
        queue, final = deque(_parts(list(range(n)), self.best_cut(np.arange(n)))), []
        while queue:
            items = queue.popleft()
            if len(items) > 1 and self.spread(items) > p.split_above:
                queue += self.resplit(items)
            else:
                final.append(items)
        singles = [x[0] for x in final if len(x) == 1]
        if len(singles) / n >= p.singles_share and len(singles) > 1:
            again = _parts(singles, self.best_cut(np.array(singles)))
            final = [x for x in final if len(x) > 1] + again
        spreads = [self.spread(x) for x in final]
        done = [x for x, s in zip(final, spreads, strict=True) if s <= p.loose_above]
        loose, new = deque(x for x, s in zip(final, spreads, strict=True) if s > p.loose_above), []
        while loose:
            items = loose.popleft()
            if self.spread(items) <= p.tight_below:
                new.append(items)
                continue
            for part in self.tighten(items, p.tight_below):
                (loose if self.spread(part) > p.tight_below and len(part) < len(items) else new).append(part)
        labels = np.zeros(n, dtype=int)
        for k, items in enumerate([*new, *done]):
            labels[items] = k
        return labels


def cluster_groups(df: DataFrame, group: str, id_: str, vec: str = "embedding", stage: str = "full", p: ClusterParams = ClusterParams()) -> DataFrame:
    """group, id and cluster of every item; stage "first" stops after the first cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        v = np.stack(pdf[vec].to_numpy()).astype(float)
        if len(pdf) > p.max_items:
            large = Vectors(v)
            labels = large.best_cut(np.arange(len(v))) if stage == "first" else large.cluster(p)
            return pd.DataFrame({group: pdf[group], "id": pdf[id_], "cluster": labels})
        d = distances(v)
        labels = (best_cut(d) if len(d) > 1 else np.zeros(len(d), dtype=int)) if stage == "first" else cluster(d, p)
        return pd.DataFrame({group: pdf[group], "id": pdf[id_], "cluster": labels})

    kind, rows = dict(df.dtypes), df.select(group, id_, vec)
    # By their bytes large groups would share a task, however long each takes; so many partitions are not joined by Spark, and few groups meet in one.
    large = rows.groupBy(group).count().filter(F.col("count") > LARGE).count()
    if large:
        rows = rows.repartition(min(2000, 16 * large), group)
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, id {kind[id_]}, cluster bigint")
