"""Communities: components, Leiden clustering with a hierarchy, links between levels, members and their edges.

Leiden clustering repeats three steps: nodes move to the neighbouring community of most gain in modularity until none gains;
each community is refined from single nodes into well-connected parts; parts become the nodes of a quotient graph, which
starts from the communities found. Nodes without edges are alone and take no part. A graph of more than ``TASK_EDGES`` edges
is coarsened by these steps over DataFrames: nodes move in blocks, each of which is a task, and communities are refined apart;
once its quotient is small enough, one task finishes it. Where it isn't to the end, communities that aren't connected are cut
into their components.

The hierarchy clusters again, by themselves, the communities of a level that have more than ``max_size`` members: each in
one task, or over DataFrames where it has more than ``SPLIT_NODES`` members or ``TASK_EDGES`` edges. One that modularity
doesn't cut, such as a star, stays whole. Every node is in one community of each level; level c0 is the coarsest.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, numbered
from . import connect, moving

#: Members of the largest community, and edges of the largest graph, that one task clusters.
SPLIT_NODES, TASK_EDGES = 50_000, 500_000
#: Gain in modularity below which moving ends, and the share of edges that a coarsening step must do away with.
LEAST_GAIN, SHRINK = 1e-6, 0.05
#: Share of a coarsening step's gain below which two more rounds are left to the next step, which moves on from its labels.
COARSE = 0.005
#: Ends of edges of a block of nodes that move in one task, and edges of a cell in which one task refines a community.
BLOCK_ENDS, CELL_EDGES = 125_000, 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the smallest node that each node of ``edges`` (src, dst) reaches."""
    return connect.components(edges, "src", "dst").select(F.col("node").alias("node_id"), F.col("root").alias("component"))


def linked(members: DataFrame) -> DataFrame:
    """(node_id, component) as ``components`` gives, of groups (node_id, least) in which each node comes with its group's smallest one.

    Nodes are first put under the smallest that any of their groups has; only those smallest ones are then connected.
    """
    members = cut_lineage(members)
    first = cut_lineage(members.groupBy("node_id").agg(F.min("least").alias("m"), F.count("*").alias("n")))
    moved = connect.lookup(members, first, "node_id", "n", members.count(), "inner").where("least <> m")
    roots = components(moved.select(F.col("least").alias("src"), F.col("m").alias("dst")).distinct())
    sizes = first.groupBy("m").agg(F.count("*").alias("n"))
    table = sizes.join(roots.withColumnRenamed("node_id", "m"), "m", "left").select("m", F.coalesce("component", "m").alias("component"), "n")
    return connect.lookup(first.select("node_id", "m"), table, "m", "n", first.count(), "inner").select("node_id", "component")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")


def strengths(edges: DataFrame) -> DataFrame:
    """(node_id, k): the weight of each node's edges, a loop's twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"), "weight")
    return ends.groupBy("node_id").agg(F.sum("weight").alias("k"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Share of weight inside communities, less what chance would put there."""
    a, b = (labels.select(F.col("node_id").alias(c), F.col("label").alias("_" + c)) for c in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("weight"))).alias("inside")).head()
    if not inside["all"]:
        return 0.0
    volume = strengths(edges).join(labels, "node_id").groupBy("label").agg(F.sum("k").alias("v"))
    squares = volume.agg(F.sum(F.col("v") * F.col("v"))).head()[0]
    return (inside["inside"] or 0.0) / inside["all"] - resolution * squares / (2 * inside["all"]) ** 2


def local_moving(edges: DataFrame, labels: DataFrame, seed: int = 42, resolution: float = 1.0, least: float = 0.0) -> DataFrame:
    """(node_id, label, k, w, d) after rounds in which nodes go to the neighbouring label of most gain in modularity.

    A block of nodes, with all their edges, is one task: there they move one after the other until none gains, each seeing
    those of its own block that moved before. Of other blocks they know the labels and volumes at the round's start, so
    nodes that move at once may spoil each other's gain. In a round nodes only go up in an order of labels, which each
    second round turns around and each two rounds draw anew; so no two nodes swap places. Modularity is taken before each
    two rounds; moving ends, with the best labels, when those bring less than ``LEAST_GAIN``, or than the share ``least``
    of all that moving has brought. So it ends, however long nodes could go on.

    ``labels`` may bring ``k``, strengths over the root of their sum; gains are then those of the graph that it is the sum
    of. ``w`` and ``d`` are the weight and number of a node's edges inside its label.
    """
    given = edges.agg(F.sum("weight"), F.count("*")).head()
    total = 2 * (given[0] or 0.0)
    if not total:
        return labels
    if "k" not in labels.columns:
        labels = labels.join(strengths(edges), "node_id", "left").select("node_id", "label", (F.coalesce("k", F.lit(0.0)) * math.sqrt(resolution / total)).alias("k"))
    n = math.ceil((2 * given[1] + 1) / BLOCK_ENDS)
    # an end of no weight to itself brings a node without neighbours
    ends = _both(edges).unionByName(labels.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("weight")))
    ends = ends.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "src"), F.lit(n)).cast("int"))
    blocks = cut_lineage(gathered(ends, "block", n, ends=["src", "dst", "weight"]).mapInArrow(moving.packed, moving.BLOCK))
    near = blocks.select("block", F.explode("nodes").alias("node_id"))
    now, best, first, score, r = cut_lineage(labels.select("node_id", "label", "k")), None, None, None, 0
    while True:
        placed = now.join(now.groupBy("label").agg(F.sum("k").alias("volume")), "label")
        rows = near.join(placed, "node_id").unionByName(blocks, allowMissingColumns=True)
        rows = gathered(rows, "block", n, seen=["node_id", "label", "k", "volume"], edges=["nodes", "own", "start", "near", "weight"])
        moved = cut_lineage(rows.mapInArrow(partial(moving.moved, r, seed), moving.MOVED))
        if r % 2 == 0:
            sums = moved.groupBy("mine").agg(F.sum("k").alias("v"), F.sum("w").alias("w")).agg(F.sum("w"), F.sum(F.col("v") * F.col("v"))).head()
            reached = (sums[0] - sums[1]) / total
            better = score is None or reached > score
            if score is not None and reached <= score + max(LEAST_GAIN, least * (reached - first)):
                return (moved if better else best).select("node_id", F.col("mine").alias("label"), "k", "w", "d")
            first = reached if first is None else first
            best, score = moved, reached
        now, r = moved.select("node_id", "label", "k"), r + 1


def gathered(rows: DataFrame, key: str, n: int, **lists: list[str]) -> DataFrame:
    """One row for each ``key``, a number below ``n`` and of its partition: lists of structs of the columns named, of rows in which the first isn't null.

    Few wide rows go to Python much faster than many.
    """
    found = (F.collect_list(F.when(F.col(c[0]).isNotNull(), F.struct(*c))).alias(name) for name, c in lists.items())
    return rows.repartitionById(n, F.col(key)).groupBy(key).agg(*found)


def _inside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends in one community, with its label."""
    a, b = (labels.select(F.col("node_id").alias(c), F.col("label").alias("_" + c)) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst", "weight", F.col("_src").alias("label"))


def connected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities cut into their components; a part is named by its smallest member, which is in no other."""
    comps = components(_inside(edges, labels)).withColumnRenamed("component", "_part")
    return labels.join(comps, "node_id", "left").select("node_id", F.coalesce("_part", "node_id").alias("label"))


def refined(edges: DataFrame, moved: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, label, k, part): labels as ``local_moving`` gives them, cut into well-connected parts that are named by a member.

    A label's nodes are refined in one task, or where they have more than ``CELL_EDGES`` edges, dealt out by chance to as
    many cells as those take: parts then grow inside cells.
    """
    sizes = moved.groupBy("label").agg(F.sum("k").alias("whole"), F.ceil(F.greatest(F.sum("d") / (2 * CELL_EDGES), F.lit(1))).alias("cells"), F.sum("d").alias("_d"))
    sizes = cut_lineage(sizes)
    n = math.ceil(((sizes.agg(F.sum("_d")).head()[0] or 0) + 1) / BLOCK_ENDS)
    cell = F.xxhash64("label", F.pmod(F.xxhash64(F.lit(seed), "node_id"), "cells"))
    rows = cut_lineage(moved.join(sizes, "label").select("node_id", "label", "k", "w", "whole", cell.alias("cell")))
    a, b = (rows.select(F.col("node_id").alias(c), F.col("cell").alias("_" + c)) for c in ("src", "dst"))
    links = edges.where("src <> dst").join(a, "src").join(b, "dst").where("_src = _dst").select(F.col("_src").alias("cell"), "src", "dst", "weight")
    both = rows.unionByName(links, allowMissingColumns=True).withColumn("cell", F.pmod("cell", F.lit(n)).cast("int"))
    rows = gathered(both, "cell", n, own=["node_id", "label", "k", "w", "whole"], links=["src", "dst", "weight"])
    return rows.mapInArrow(_refine, "node_id long, label long, k double, part long")


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of nodes, own (node_id, label, k, w, whole), by those edges, links (src, dst, weight), that lie inside cells."""
    for own, links in ([moving.columns(b, c, i) for c in ("own", "links")] for b in batches for i in range(b.num_rows)):
        at = np.argsort(own["node_id"])
        names, labels, k, inner, whole = (own[c][at] for c in ("node_id", "label", "k", "w", "whole"))
        _, label = np.unique(labels, return_inverse=True)
        g, order = _Graph(len(names)), np.lexsort((links["dst"], links["src"]))
        a, b = (np.searchsorted(names, links[c][order]).tolist() for c in ("src", "dst"))
        for x, y, w in zip(a, b, links["weight"][order].tolist()):
            g.add(x, y, w)
        part = _refined(g, k.tolist(), 1.0, label.tolist(), inner.tolist(), dict(zip(label.tolist(), whole.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, labels, k, names[np.array(part)])], names=["node_id", "label", "k", "part"])


def leiden(edges: DataFrame, nodes: DataFrame, seed: int = 42, task_edges: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(node_id, label): communities of the whole graph (src, dst, weight) by Leiden clustering; isolated nodes are alone.

    Nodes go by their numbers in the order of their names, or by their names if those are numbers, and labels by those of a
    member. With ``groups`` (node_id, group), between which no edge leads, each group is clustered as a graph of its own.
    """
    most = TASK_EDGES if task_edges is None else task_edges
    given = cut_lineage(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    linked = cut_lineage(given.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct())
    alone = nodes.select("node_id").join(linked, "node_id", "left_anti").select("node_id", F.col("node_id").cast("string").alias("label"))
    names, graph = numbered_graph(nodes.select("node_id").join(linked, "node_id", "left_semi"), given)
    first = graph
    groups = names.select("at", F.lit(0).alias("group")) if groups is None else names.join(groups, "node_id").select("at", "group")
    ks = strengths(graph).withColumnRenamed("node_id", "at").join(groups, "at")
    ks = ks.join(ks.groupBy("group").agg(F.sum("k").alias("_all")), "group")
    k = F.when(F.col("_all") > 0, F.col("k") / F.sqrt("_all")).otherwise(F.lit(0.0))
    labels = cut_lineage(ks.select(F.col("at").alias("node_id"), F.col("at").alias("label"), k.alias("k"), "group"))
    place = labels.select("node_id", F.col("node_id").alias("at"))  # where each node is in the quotient graph
    size, r = _largest(graph, labels), 0
    while size > most:
        moved = local_moving(graph, labels.select("node_id", "label", "k"), seed + r, least=COARSE)
        if "w" not in moved.columns:
            break
        parts = cut_lineage(refined(graph, moved, seed + r).join(labels.select("node_id", "group"), "node_id"))
        graph = cut_lineage(_quotient(graph, parts.select("node_id", F.col("part").alias("label"))))
        place = cut_lineage(place.join(parts.select(F.col("node_id").alias("at"), "part"), "at").select("node_id", F.col("part").alias("at")))
        labels = cut_lineage(parts.groupBy(F.col("part").alias("node_id")).agg(F.min("label").alias("label"), F.sum("k").alias("k"), F.min("group").alias("group")))
        before, size, r = size, _largest(graph, labels), r + 1
        if size > (1 - SHRINK) * before:
            break
    if size <= most:
        labels = _finished(graph, labels)
    found = place.join(labels.select(F.col("node_id").alias("at"), "label"), "at").select("node_id", "label")
    found = cut_lineage(connected(first, found)) if size > most else found
    found = names.join(found.withColumnRenamed("node_id", "at"), "at").select("node_id", F.format_string("%012d", "label").alias("label"))
    return found.unionByName(alone)


def numbered_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, at) with numbers in the order of their names, and edges by those; names that are numbers stay."""
    if dict(nodes.dtypes)["node_id"] == "bigint":
        return nodes.select("node_id", F.col("node_id").alias("at")), edges
    names = cut_lineage(numbered(nodes.select("node_id"), ["node_id"], "at"))
    a, b = (names.select(F.col("node_id").alias(c), F.col("at").alias("_" + c)) for c in ("src", "dst"))
    return names, cut_lineage(edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "weight"))


def _largest(graph: DataFrame, labels: DataFrame) -> int:
    """Edges of the group that has most."""
    return graph.join(labels.select(F.col("node_id").alias("src"), "group"), "src").groupBy("group").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]


def _quotient(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The graph of parts: weights between two of them together, those inside one as a loop."""
    a, b = (parts.select(F.col("node_id").alias(c), F.col("label").alias("_" + c)) for c in ("src", "dst"))
    rows = edges.join(a, "src").join(b, "dst").select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"), "weight")
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _finished(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of groups that each fit one task, from those they have; nodes are numbers."""
    none = F.lit(-1).cast("long")
    rows = graph.join(labels.select(F.col("node_id").alias("src"), "group"), "src").select("group", "src", "dst", "weight", none.alias("label"))
    rows = rows.unionByName(labels.select("group", F.col("node_id").alias("src"), none.alias("dst"), F.lit(0.0).alias("weight"), "label"))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"] < 0].sort_values("src")
        names, links = own["src"].tolist(), pdf[pdf["dst"] >= 0].sort_values(["src", "dst"])
        got = clustered(names, list(zip(links["src"].tolist(), links["dst"].tolist(), links["weight"].tolist())), own["label"].tolist())
        return pd.DataFrame({"node_id": names, "label": got})

    return _dealt(rows, "group").groupBy("group").applyInPandas(cluster, "node_id long, label long")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by ``key`` in partitions that stay apart, however few bytes they have: tasks take long for them."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


class _Graph:
    """A small graph: neighbours and loops by number."""

    def __init__(self, n: int):
        self.near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        self.loop = [0.0] * n

    def add(self, a: int, b: int, w: float):
        if a == b:
            self.loop[a] += w
        else:
            self.near[a][b] += w
            self.near[b][a] += w

    def strength(self) -> list[float]:
        return [sum(x.values()) + 2 * o for x, o in zip(self.near, self.loop)]


def _moved(g: _Graph, k: list[float], total: float, label: list[int]) -> list[int]:
    """Nodes, in order and again after a neighbour has moved, go to the neighbouring community of most gain."""
    volume: dict[int, float] = defaultdict(float)
    for n, c in enumerate(label):
        volume[c] += k[n]
    todo, waiting = list(range(len(label)))[::-1], [True] * len(label)
    later: list[int] = []
    while todo or later:
        if not todo:
            todo, later = later[::-1], []
        n = todo.pop()
        waiting[n] = False
        pull: dict[int, float] = defaultdict(float)
        for m, w in g.near[n].items():
            pull[label[m]] += w
        mine, own = label[n], k[n]
        volume[mine] -= own
        best, top = mine, round(pull.get(mine, 0.0) - own * volume[mine] / total, 9)
        for c, w in pull.items():
            gain = round(w - own * volume[c] / total, 9)
            # ties stay, or go to the smallest label
            if gain > top or gain == top and best != mine and c < best:
                best, top = c, gain
        volume[best] += k[n]
        if best != mine:
            label[n] = best
            for m in g.near[n]:
                if not waiting[m] and label[m] != best:
                    waiting[m] = True
                    later.append(m)
    return label


def _refined(g: _Graph, k: list[float], total: float, label: list[int], inner: list[float] | None = None, whole: dict[int, float] | None = None) -> list[int]:
    """Parts of communities: a node that is alone joins the part of most gain in its community, if both are well connected to it.

    ``inner`` and ``whole`` are each node's weight into its community and that one's volume, where the graph has not all of it.
    """
    part, volume, members = list(range(len(label))), list(k), [1] * len(label)
    if whole is None:
        whole = defaultdict(float)
        for n, c in enumerate(label):
            whole[c] += k[n]
    if inner is None:
        inner = [sum(w for m, w in g.near[n].items() if label[m] == label[n]) for n in range(len(label))]
    cut = list(inner)  # weight from each part to the rest of its community
    for n in range(len(label)):
        if part[n] != n or members[n] > 1 or inner[n] < k[n] * (whole[label[n]] - k[n]) / total - 1e-12:
            continue
        pull: dict[int, float] = defaultdict(float)
        for m, w in g.near[n].items():
            if label[m] == label[n]:
                pull[part[m]] += w
        fits = [p for p in pull if cut[p] >= volume[p] * (whole[label[n]] - volume[p]) / total - 1e-12]
        best = max(fits, key=lambda p: (round(pull[p] - k[n] * volume[p] / total, 9), -p), default=None)  # noqa: B023
        if best is not None and round(pull[best] - k[n] * volume[best] / total, 9) > 0:
            part[n] = best
            members[best] += 1
            members[n] = 0
            volume[best] += k[n]
            cut[best] += inner[n] - 2 * pull[best]
    return part


def clustered(names: list, links: list[tuple], start: list | None = None) -> list[int]:
    """Communities of one small graph by Leiden clustering, numbered in the order of their first members; ``names`` are in order.

    It is run again from what it found, until that stays.
    """
    at = {n: i for i, n in enumerate(names)}
    base = _Graph(len(names))
    for a, b, w in links:
        base.add(at[a], at[b], w)
    total = sum(base.strength()) or 1.0
    first: dict = {}
    found = [first.setdefault(c, len(first)) for c in (names if start is None else start)]
    while True:
        again = _parts(base, _pass(base, total, list(found)))
        if again == found:
            return found
        found = again


def _pass(base: _Graph, total: float, label: list[int]) -> list[int]:
    """Moving, refinement and aggregation until each community is one node of the quotient graph."""
    g, where = base, list(range(len(label)))
    while True:
        k = g.strength()
        label = _moved(g, k, total, label)
        if len(set(label)) == len(label):
            return [label[i] for i in where]
        part = _refined(g, k, total, label)
        if len(set(part)) == len(part):
            part = label  # refinement keeps all nodes apart: communities are the next nodes
        numbers: dict[int, int] = {}
        part = [numbers.setdefault(p, len(numbers)) for p in part]
        small, of = _Graph(len(numbers)), [0] * len(numbers)
        for n, p in enumerate(part):
            of[p] = label[n]
            small.loop[p] += g.loop[n]
            for m, w in g.near[n].items():
                if n < m:
                    small.add(p, part[m], w)
        where = [part[i] for i in where]
        g, label = small, of


def _parts(g: _Graph, label: list[int]) -> list[int]:
    """Communities cut into connected ones, numbered in the order of their first members."""
    out, found = [-1] * len(label), 0
    for n in range(len(label)):
        if out[n] >= 0:
            continue
        out[n], stack = found, [n]
        while stack:
            i = stack.pop()
            for m in g.near[i]:
                if out[m] < 0 and label[m] == label[i]:
                    out[m] = found
                    stack.append(m)
        found += 1
    return out


def split(edges: DataFrame, labels: DataFrame, max_size: int, seed: int = 42) -> DataFrame:
    """Communities of more than ``max_size`` members clustered again by their own edges; others as they are."""
    kinds, inside = dict(labels.dtypes), cut_lineage(_inside(edges, labels))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).join(inside.groupBy("label").agg(F.count("*").alias("e")), "label", "left")
    huge = (F.col("n") > SPLIT_NODES) | (F.coalesce("e", F.lit(0)) > TASK_EDGES)
    kind = F.when(F.col("n") <= max_size, "rest").when(huge, "huge").otherwise("task")
    rows = cut_lineage(labels.join(sizes.select("label", kind.alias("kind")), "label"))
    task = inside.join(sizes.where(kind == "task").select("label"), "label", "left_semi")
    task = task.unionByName(rows.where("kind = 'task'").select("label", F.col("node_id").alias("src"), F.lit(None).cast(kinds["node_id"]).alias("dst"), F.lit(0.0).alias("weight")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(pdf.loc[pdf["dst"].isna(), "src"])
        links = pdf[pdf["dst"].notna()].sort_values(["src", "dst"])
        got = clustered(members, list(zip(links["src"], links["dst"], links["weight"])))
        return pd.DataFrame({"node_id": members, "label": [f"{pdf['label'].iloc[0]}/{c:06d}" for c in got]})

    out = rows.where("kind = 'rest'").select("node_id", "label").unionByName(_dealt(task, "label").groupBy("label").applyInPandas(cut, f"node_id {kinds['node_id']}, label string"))
    large = rows.where("kind = 'huge'").select("node_id", "label")
    if large.isEmpty():
        return out
    # all of them at once, each as a graph of its own
    again = inside.join(large.select("label").distinct(), "label", "left_semi").select("src", "dst", "weight")
    moved = leiden(again, large, seed, groups=large.select("node_id", F.col("label").alias("group"))).withColumnRenamed("label", "_to")
    return out.unionByName(large.join(moved, "node_id").select("node_id", F.concat_ws("/", "label", "_to").alias("label")))


def hierarchy(nodes: DataFrame, edges: DataFrame, max_size: int = 10, max_levels: int = 3, seed: int = 42) -> DataFrame:
    """(node_id, level, community_id) for levels c0 (coarsest) to the finest; isolated nodes are alone."""
    names, graph = numbered_graph(nodes, edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    labels, out = cut_lineage(leiden(graph, names.select(F.col("at").alias("node_id")), seed)), None
    for level in range(max_levels):
        rows = _named(labels, f"c{level}")
        out = rows if out is None else out.unionByName(rows)
        if level + 1 < max_levels:
            labels = cut_lineage(split(graph, labels, max_size, seed))
    return names.join(out.withColumnRenamed("node_id", "at"), "at").select("node_id", "level", "community_id")


def one_level(nodes: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """(node_id, level, community_id) of a single level, c1, without splitting; the largest communities come first."""
    labels = cut_lineage(leiden(edges, nodes, seed))
    sizes = labels.groupBy("label").agg((-F.count("*")).alias("size"), F.min("node_id").alias("first"))
    index = numbered(sizes, ["size", "first"], "index")
    return labels.join(index, "label").select("node_id", F.lit("c1").alias("level"), F.format_string("comm_c1_%04d", "index").alias("community_id"))


def _named(labels: DataFrame, level: str) -> DataFrame:
    """Community ids in the order of their smallest members."""
    first = labels.groupBy("label").agg(F.min("node_id").alias("first"))
    index = numbered(first, ["first"], "index")
    return labels.join(index, "label").select("node_id", F.lit(level).alias("level"), F.format_string("comm_%s_%04d", F.lit(level), "index").alias("community_id"))


def internal_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(level, community_id, src, dst) of edges with both ends in one community."""
    a = membership.select(F.col("node_id").alias("src"), "level", "community_id")
    b = membership.select(F.col("node_id").alias("dst"), "level", "community_id")
    return edges.join(a, "src").join(b, ["dst", "level", "community_id"])


def parts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(node_id, level, community_id, part): the connected part of its community in which each node is, by the part's smallest node.

    Nodes and levels are numbers. Tasks first keep a tree of each community's edges that they have, then one of those trees;
    what is left to connect grows with nodes and not with edges.
    """
    trees = internal_edges(edges.select("src", "dst"), membership).select("level", "community_id", "src", "dst")
    trees = trees.mapInArrow(moving.trees, moving.TREES).repartition("level", "community_id").mapInArrow(moving.trees, moving.TREES)
    levels = membership.agg(F.coalesce(F.max("level"), F.lit(0))).head()[0] + 1
    # a node is another one at each level
    roots = components(trees.select(*((F.col(c) * levels + F.col("level")).alias(c) for c in ("src", "dst"))))
    roots = roots.select(F.floor(F.col("node_id") / levels).alias("node_id"), (F.col("node_id") % levels).cast("int").alias("level"), F.floor(F.col("component") / levels).alias("part"))
    return membership.join(roots, ["node_id", "level"], "left").withColumn("part", F.coalesce("part", "node_id"))


def parents(membership: DataFrame) -> DataFrame:
    """(child, parent) between each level and the next coarser one that is present; of several parents the last one."""
    order = membership.select("level").distinct().withColumn("i", F.row_number().over(Window.orderBy("level")))
    rows = membership.join(F.broadcast(order), "level")
    child, parent = rows.select("node_id", "i", F.col("community_id").alias("child")), rows.select("node_id", (F.col("i") + 1).alias("i"), F.col("community_id").alias("parent"))
    return child.join(parent, ["node_id", "i"]).groupBy("child").agg(F.max("parent").alias("parent"))


def annotated(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Nodes with a map from levels to communities."""
    maps = membership.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "community_id")))).alias("community_ids"))
    return nodes.join(maps, "node_id", "left")


def stats(membership: DataFrame) -> DataFrame:
    """Communities and sizes of each level, and over all levels (level null)."""
    sizes = membership.groupBy("level", "community_id").agg(F.count("*").alias("n"))
    return sizes.groupingSets([("level",), ()], "level").agg(F.count("*").alias("communities"), F.round(F.avg("n"), 1).alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
