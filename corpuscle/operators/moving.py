"""Tasks of ``community.local_moving``: blocks of nodes with their edges as arrays, and the moves inside a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A block: all nodes that its edges name, in order; places of its own nodes among them; where each one's edges begin; ends and weights of those.
BLOCK = "block int, nodes array<long>, own array<int>, start array<int>, near array<int>, weight array<double>"
#: A node with the label that it had, its strength, the weight and number of its edges inside that label, and the label it goes to.
MOVED = "node_id long, mine long, k double, w double, d long, label long"

#: Edges of a level's community.
TREES = "level int, community_id long, src long, dst long"


def columns(batch: pa.RecordBatch, name: str, i: int) -> dict[str, np.ndarray]:
    """The fields of a row's list of structs."""
    rows = batch.column(name)[i].values
    return {f.name: rows.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(rows.type)}


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ends (src, dst, weight), which come in both directions."""
    for b in batches:
        for i in range(b.num_rows):
            src, dst, weight = columns(b, "ends", i).values()
            at = np.lexsort((dst, src))
            nodes, places = np.unique(np.concatenate([src[at], dst[at]]), return_inverse=True)
            own, start = np.unique(places[: len(at)], return_index=True)
            arrays = [(nodes, pa.int64()), (own, pa.int32()), (np.append(start, len(at)), pa.int32()), (places[len(at) :], pa.int32()), (weight[at], pa.float64())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v.astype(kind.to_pandas_dtype()), kind)) for v, kind in arrays]
            yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), *lists], names=["block", "nodes", "own", "start", "near", "weight"])


def moved(r: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One round of blocks, each with what is seen (node_id, label, k, volume) of all nodes that its edges name."""
    for b in batches:
        for i in range(b.num_rows):
            nodes, own, start, near, weight = (x.values.to_numpy() for x in b.column("edges")[i].values[0].values())
            node, label, k, volume = columns(b, "seen", i).values()
            at = np.argsort(node)
            if not np.array_equal(node[at], nodes):
                raise ValueError("a block's nodes are not those it names")
            names, places = np.unique(label[at], return_inverse=True)
            k, volumes = k[at], np.zeros(len(names))
            volumes[places] = volume[at]
            of = np.repeat(own, np.diff(start))
            inside = (places[near] == places[of]) & (near != of)
            w, d = (np.add.reduceat(v * inside, start[:-1]) for v in (weight, np.ones(len(near), np.int64)))
            order = _order(names, r, seed)
            first = _gaining(own, start, near, weight, places, volumes, order, k, w)
            to = _moves(first, own.tolist(), start.tolist(), near.tolist(), weight.tolist(), places.tolist(), volumes.tolist(), order.tolist(), k.tolist()) if first else places
            out = [nodes[own], names[places[own]], k[own], w, d, names[np.array(to)[own]]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["node_id", "mine", "k", "w", "d", "label"])


def _order(names: np.ndarray, r: int, seed: int) -> np.ndarray:
    """Each label's place in the order of round ``r``, the same in all blocks."""
    x = names.astype(np.uint64) + np.uint64((seed * 1_000_003 + r // 2) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ~x if r % 2 else x


def _gaining(own: np.ndarray, start: np.ndarray, near: np.ndarray, weight: np.ndarray, label: np.ndarray, volume: np.ndarray, order: np.ndarray, k: np.ndarray, w: np.ndarray) -> list[int]:
    """Numbers of own nodes that gain by a move as the round begins; others wait until a neighbour has moved."""
    i = np.repeat(np.arange(len(own)), np.diff(start))
    real = near != own[i]
    pair = i[real] * len(volume) + label[near[real]]
    if not len(pair):
        return []
    at = np.argsort(pair, kind="stable")
    begin = np.flatnonzero(np.diff(pair[at], prepend=-1))
    pull, (i, c) = np.add.reduceat(weight[real][at], begin), np.divmod(pair[at][begin], len(volume))
    mine, strength = label[own], k[own]
    stay = np.round(w - strength * (volume[mine] - strength), 9)
    gain = np.round(pull - strength[i] * volume[c], 9)
    return np.unique(i[(order[c] > order[mine[i]]) & (gain > stay[i])]).tolist()


def _moves(first: list[int], own: list[int], start: list[int], near: list[int], weight: list[float], label: list[int], volume: list[float], order: list[int], k: list[float]) -> list[int]:
    """Own nodes, the ``first`` ones in order and others after a neighbour has moved, go to the label of most gain that lies further up."""
    of = {n: i for i, n in enumerate(own)}
    todo, later, waiting = first[::-1], [], [False] * len(own)
    for i in first:
        waiting[i] = True
    while todo or later:
        if not todo:
            todo, later = later[::-1], []
        i = todo.pop()
        waiting[i] = False
        n, ends = own[i], near[start[i] : start[i + 1]]
        mine, up = label[n], order[label[n]]
        pull: dict[int, float] = {}
        for m, w in zip(ends, weight[start[i] : start[i + 1]]):
            if m != n:
                c = label[m]
                pull[c] = pull.get(c, 0.0) + w
        strength = k[n]
        volume[mine] -= strength
        best, top = mine, round(pull.get(mine, 0.0) - strength * volume[mine], 9)
        for c, w in pull.items():
            if order[c] > up:
                gain = round(w - strength * volume[c], 9)
                # ties stay, or go to the smallest label
                if gain > top or gain == top and best != mine and c < best:
                    best, top = c, gain
        volume[best] += strength
        if best != mine:
            label[n] = best
            for m in ends:
                j = of.get(m)
                if j is not None and not waiting[j] and label[m] != best:
                    waiting[j] = True
                    later.append(j)
    return label


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (level, community_id, src, dst) as stars (src, and the smallest node that it reaches as dst) of the same connected parts."""
    up: dict[tuple[int, int, int], int] = {}

    def root(key: tuple[int, int], n: int) -> int:
        path = []
        while (above := up.setdefault((*key, n), n)) != n:
            path.append(n)
            n = above
        for x in path:
            up[*key, x] = n
        return n

    for b in batches:
        for level, c, src, dst in zip(*(b.column(x).to_pylist() for x in ("level", "community_id", "src", "dst"))):
            a, z = root((level, c), src), root((level, c), dst)
            if a != z:
                up[level, c, max(a, z)] = min(a, z)
    rows = [(*key[:2], key[2], root(key[:2], key[2])) for key in list(up)]
    rows = [x for x in rows if x[2] != x[3]]
    for at in range(0, len(rows), 100_000):
        level, c, src, dst = zip(*rows[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), *(pa.array(x, pa.int64()) for x in (c, src, dst))], names=["level", "community_id", "src", "dst"])
