"""Breadth-first traversal, path counts, dependencies and exact betweenness.

Three plans with equal results:

* **broadcast**: the adjacency goes to every executor as compressed rows, and a task runs its sources in numpy, as many
  at once as ``AT_ONCE`` allows; exact values of parts of few levels are by matrices. Taken when the edges are at most ``MOST_BROADCAST_EDGES`` (their number is checked first).
* **parts**: beyond that bound, each connected part goes to the tasks that run its sources, and nothing through the driver;
  small parts share a task, sources of a large one are dealt to several. Taken by parts of at most ``MOST_PART_EDGES`` edges.
* **joins**: level-synchronous DataFrame loops for larger parts. Each level is written out, which cuts the
  lineage; a level needs an anti-join with the two levels before it only, since edges go both ways.

Sources are distributed, so all-pairs work is spread over the cluster and summed per task before it is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .scalars import GraphOf, connected_components, degrees

#: 16 bytes an edge on each executor, and some ten times that on the driver while the arrays are made.
MOST_BROADCAST_EDGES = 1_000_000
MOST_PART_EDGES = 8_000_000  # of a connected part whose arrays are one task's; larger ones take the joins plan
AT_ONCE = 1 << 17  # edges and nodes of the sources that are searched together
WORK = 200_000_000  # edges and nodes that a task visits
MOST_TASKS = 4000
HELD = 1 << 18  # rows of small parts that a task takes together
MOST_REACHED = 4_000_000_000  # rows of (source, node) that the joins plan writes at once
MOST_LEVELS = 10_000  # of the joins plan; a deeper graph raises
DENSE_NODES, DENSE_WORK = 256, 1 << 18  # nodes at least, edges and nodes at most, of a part that is searched by matrices
DENSE_LEVELS = 12  # of its first search, at most
DENSE_SOURCES = 16  # columns of a matrix, so that a part's matrices stay in a core's cache
WIDE = 64  # neighbours of a node that are added one after the other
CACHED = 1 << 16  # numbers of a block of rows whose sums are made together


class Adjacency:
    """Compressed sparse rows over dense ids, by part and id; neighbours ascend by original id, and no edge leaves a part."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, part: np.ndarray | None = None):
        """``part``: of each edge, a number that ascends with the rows; without it parts are cut where no edge goes across."""
        if part is None:
            self.ids = np.unique(np.concatenate([src, dst]))
            s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
            n = len(self.ids)
            open_edges = np.cumsum(np.bincount(np.minimum(s, d), minlength=n) - np.bincount(np.maximum(s, d), minlength=n)) if n else np.zeros(0, np.int64)
            cuts = np.append(0, np.flatnonzero(open_edges == 0) + 1)
        else:
            order = np.lexsort((src, part))
            fresh = np.concatenate([[True], (np.diff(src[order]) != 0) | (np.diff(part[order]) != 0)]) if len(src) else np.zeros(0, bool)
            self.ids, of = src[order][fresh], part[order][fresh]
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
            by_id = np.argsort(self.ids)
            s, d = (by_id[np.searchsorted(self.ids, x, sorter=by_id)] for x in (src, dst))
        self.by_id = np.argsort(self.ids)
        order = np.lexsort((d, s))
        self.to = d[order]
        self.at = np.searchsorted(s[order], np.arange(len(self.ids) + 1))
        size = np.diff(cuts)
        self.base, self.size = np.repeat(cuts[:-1], size), np.repeat(size, size)  # of each node's part
        self.work = np.repeat(self.at[cuts[1:]] - self.at[cuts[:-1]], size) + self.size  # edges and nodes of each node's part

    def dense(self, nodes: np.ndarray) -> np.ndarray:
        """The places of those ids that are nodes."""
        if not len(self.ids):
            return np.zeros(0, np.int64)
        i = self.by_id[np.minimum(np.searchsorted(self.ids, nodes, sorter=self.by_id), len(self.ids) - 1)]
        return i[self.ids[i] == nodes]

    def searches(self, sources: np.ndarray) -> Iterator[Searches]:
        """Of places, together as many as ``AT_ONCE`` edges and nodes allow, at least one."""
        ends, at = np.cumsum(self.work[sources]), 0
        while at < len(sources):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield Searches(self, sources[at:to])
            at = to

    def totals(self, sources: np.ndarray) -> np.ndarray:
        """The sources' dependencies on every place, added up: of parts of few levels by matrices, of all others by slots."""
        total = np.zeros(len(self.ids))
        fit = (self.size[sources] >= DENSE_NODES) & (self.work[sources] <= DENSE_WORK)
        mine = sources[fit][np.argsort(self.base[sources[fit]], kind="stable")]
        rest = [sources[~fit]]
        for own in np.split(mine, np.flatnonzero(np.diff(self.base[mine])) + 1):
            made = DenseSearches.of(self, own) if len(own) > DENSE_SOURCES else None
            if made is None:
                rest.append(own)
            else:
                total[made.base : made.base + made.n] += made.totals(own)
        for s in self.searches(np.concatenate(rest)):
            np.add.at(total, s.place, s.dependencies())
        return total


class NeighbourSums:
    """Sums of neighbours' rows, for rows of falling degree: the j-th neighbours of all rows that have so many are added at once.

    Rows are taken in blocks that a core's cache holds; those of more than ``WIDE`` neighbours are sums of sums.
    """

    def __init__(self, at: np.ndarray, to: np.ndarray):
        n, begins, self.then = np.diff(at), at[:-1], None
        if n.max(initial=0) > WIDE:
            pieces = -(-n // WIDE)
            ends = np.cumsum(pieces)
            row = np.repeat(np.arange(len(n)), pieces)
            begins = begins[row] + (np.arange(len(row)) - (ends - pieces)[row]) * WIDE
            n = np.minimum(WIDE, at[1:][row] - begins)
            order = np.argsort(-n, kind="stable")
            begins, n = begins[order], n[order]
            self.then = NeighbourSums(np.append(0, ends), np.argsort(order))
        self.rows = len(n)
        self.columns = [to[begins[:k] + j] for j in range(int(n.max(initial=0))) for k in [int(np.searchsorted(-n, -j, "left"))]]
        self.room: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, x: np.ndarray, out: np.ndarray) -> None:
        wide = x.shape[1]
        block = max(1, CACHED // max(1, wide))
        if wide not in self.room:
            self.room[wide] = np.empty((min(block, self.rows), wide)), np.empty((self.rows if self.then else 0, wide))
        each, pieces = self.room[wide]
        sums = pieces if self.then else out
        for lo in range(0, self.rows, block):
            part = sums[lo : lo + block]
            reached = 0
            for j, column in enumerate(self.columns):
                column = column[lo : lo + block]
                k = len(column)
                if not k:
                    break
                x.take(column, 0, out=each[:k] if j else part[:k], mode="clip")
                if j:
                    np.add(part[:k], each[:k], out=part[:k])
                else:
                    reached = k
            part[reached:] = 0
        if self.then:
            self.then(sums, out)


class DenseSearches:
    """Searches of one connected part of few levels by matrices: a row for each node, a column for each source.

    A level costs all edges for each source, but a few instructions an edge. The nodes of a graph of two sides are in front by
    turns, so a level is one side's. Path counts are whole numbers, 0 where a node is not of the level.
    """

    def __init__(self, g: Adjacency, base: int, n: int, side: np.ndarray):
        self.base, self.n, self.rooms = base, n, {}
        at = g.at[base : base + n + 1] - g.at[base]
        deg = np.diff(at)
        self.order = np.lexsort((-deg, side))
        self.new = np.argsort(self.order)
        src, dst = self.new[np.repeat(np.arange(n), deg)], self.new[g.to[g.at[base] : g.at[base + n]] - base]
        order = np.argsort(src, kind="stable")
        at, dst = np.searchsorted(src[order], np.arange(n + 1)), dst[order]
        first = int((side == 0).sum())
        self.begin, self.size = (0, first), [first, n - first]
        self.other = (1, 0) if first < n else (0, 0)
        ends = [(0, first), (first, n)][: 1 + (first < n)]
        self.near = [NeighbourSums(at[lo : hi + 1] - at[lo], dst[at[lo] : at[hi]] - self.begin[self.other[k]]) for k, (lo, hi) in enumerate(ends)]

    @classmethod
    def of(cls, g: Adjacency, sources: np.ndarray) -> DenseSearches | None:
        """None if the part of the sources is too deep, or not connected."""
        s = Searches(g, sources[:1])
        if len(s.levels) - 1 > DENSE_LEVELS or (s.dist < 0).any():
            return None
        base, n = int(g.base[sources[0]]), s.many
        side = s.dist & 1
        src = np.repeat(side, np.diff(g.at[base : base + n + 1]))
        return cls(g, base, n, side if (src != side[g.to[g.at[base] : g.at[base + n]] - base]).all() else np.zeros(n, side.dtype))

    def totals(self, sources: np.ndarray) -> np.ndarray:
        """The dependencies of the sources on all nodes of the part, added up."""
        places = np.sort(self.new[sources - self.base])
        total, cut = np.zeros(self.n), int(np.searchsorted(places, self.size[0]))
        sides = [total[: self.size[0]], total[self.size[0] :]]
        for k, mine in enumerate((places[:cut], places[cut:] - self.begin[1])):
            for lo in range(0, len(mine), DENSE_SOURCES):
                self._add(k, mine[lo : lo + DENSE_SOURCES], sides)
        return total[self.new]

    def _add(self, k: int, roots: np.ndarray, total: list[np.ndarray]) -> None:
        wide = len(roots)
        room = self._room(wide)
        unseen, shares, sums = room["unseen"], room["shares"], room["sums"]
        for u in unseen:
            u.fill(1)
        unseen[k][roots, np.arange(wide)] = 0
        front = shares[k]
        front.fill(0)
        front[roots, np.arange(wide)] = 1
        levels, left = [], self.n * wide - wide
        while left:
            k = self.other[k]
            if len(levels) == len(room["levels"]):
                room["levels"].append(np.empty((max(self.size), wide)))
            paths, fresh = room["levels"][len(levels)][: self.size[k]], room["fresh"][: self.size[k]]
            self.near[k](front, paths)
            np.multiply(paths, unseen[k], out=paths)
            np.minimum(paths, 1, out=fresh)
            np.subtract(unseen[k], fresh, out=unseen[k])
            left -= int(fresh.sum())
            levels.append((k, paths))
            front = paths
        below = None
        while len(levels) > 1 or below is not None:
            k, paths = levels.pop()
            if below is not None:
                total[k] += np.einsum("ij,ij->i", paths, below)
            if not levels:
                break
            share, fresh = shares[k], room["fresh"][: self.size[k]]
            np.divide(1, np.maximum(paths, 1, out=share), out=share)
            if below is not None:
                np.add(share, below, out=share)
            np.multiply(share, np.minimum(paths, 1, out=fresh), out=share)
            k = self.other[k]
            below = sums[k]
            self.near[k](share, below)

    def _room(self, wide: int) -> dict[str, list[np.ndarray]]:
        """Matrices that all steps use again: new ones cost more than the sums."""
        if wide not in self.rooms:
            each = {name: [np.empty((m, wide)) for m in self.size] for name in ("unseen", "shares", "sums")}
            self.rooms[wide] = {**each, "fresh": np.empty((max(self.size), wide)), "levels": []}
        return self.rooms[wide]


class Searches:
    """Levels in queue order, path counts and first discoverers from many sources at once.

    Each source has a slot for each node of its part; slots of a source are next to each other.
    """

    def __init__(self, g: Adjacency, sources: np.ndarray):
        size = g.size[sources]
        ends = np.cumsum(size)
        shift = ends - size - g.base[sources]  # from a node's place to its slot
        self.g, self.sources, self.many = g, sources, int(ends[-1])
        self.source = np.repeat(sources, size)
        self.place = np.arange(self.many) - np.repeat(shift, size)
        self.dist, self.sigma, self.parent = np.full(self.many, -1, np.int32), np.zeros(self.many), np.full(self.many, -1)
        self.roots = sources + shift
        self.dist[self.roots], self.sigma[self.roots] = 0, 1
        self.levels, self.steps = [self.roots], []
        slot = np.empty(self.many, np.int64)
        while len(self.levels[-1]):
            front = self.levels[-1]
            node = self.place[front]
            n = g.at[node + 1] - g.at[node]
            who = np.repeat(np.arange(len(front)), n)
            to = g.to[np.arange(len(who)) + np.repeat(g.at[node] - np.cumsum(n) + n, n)] + (front - node)[who]
            fresh = self.dist[to] < 0
            up, to = front[who[fresh]], to[fresh]
            np.add.at(self.sigma, to, self.sigma[up])
            self.steps.append((up, to))
            slot[to[::-1]] = np.arange(len(to))[::-1]  # the first of a slot's discoverers stays
            first = slot[to] == np.arange(len(to))
            found = to[first]
            self.parent[found], self.dist[found] = up[first], len(self.levels)
            self.levels.append(found)

    def dependencies(self) -> np.ndarray:
        """The source's dependency on every slot's node, 0 on itself."""
        delta = np.zeros(self.many)
        for up, to in reversed(self.steps):
            np.add.at(delta, up, self.sigma[up] / self.sigma[to] * (1 + delta[to]))
        delta[self.roots] = 0
        return delta

    def queue(self) -> np.ndarray:
        """Reached slots, by source and then in the order of its queue."""
        slots = np.concatenate(self.levels)
        return slots[np.argsort(np.searchsorted(self.roots - self.sources + self.g.base[self.sources], slots, "right"), kind="stable")]


def fits_broadcast(edges: DataFrame, most: int = MOST_BROADCAST_EDGES) -> bool:
    return edges.limit(most + 1).count() <= most


def shipped(edges: DataFrame):
    """The adjacency as a broadcast variable; only for edges that ``fits_broadcast``."""
    t = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).toArrow()
    return edges.sparkSession.sparkContext.broadcast(Adjacency(t.column(0).to_numpy(), t.column(1).to_numpy()))


def _spread(sources: DataFrame) -> DataFrame:
    """Distinct sources over as many partitions as there are cores, since each may cost a whole traversal."""
    col = sources.columns[0]
    n = max(sources.sparkSession.sparkContext.defaultParallelism, 1)
    return sources.select(F.col(col).cast("long").alias("source")).distinct().repartition(n, "source")


Run = Callable[[Adjacency, np.ndarray, np.ndarray | None], Iterator[pa.RecordBatch]]
EDGE, SOURCE, TARGET = range(3)


def _traversed(
    edges: DataFrame, sources: DataFrame, run: Run, schema: str, plan: str | None, targets: DataFrame | None = None, labels: DataFrame | None = None
) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """What ``run`` makes of the sources (and the distinct targets) by arrays; the edges and the sources of parts that are too large for that, which may be none.

    ``labels``: written connected components (node, component), if they are there already.
    """
    if plan == "joins":
        return None, edges, _spread(sources)
    if plan == "broadcast" or plan is None and fits_broadcast(edges):
        graph = shipped(edges)
        # targets are nodes, of which a graph that fits has at most twice as many as edges
        only = None if targets is None else edges.sparkSession.sparkContext.broadcast(targets.toArrow().column(0).to_numpy())

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = [b.column(0).to_numpy() for b in batches]
            if mine:
                g = graph.value
                yield from run(g, g.dense(np.concatenate(mine)), None if only is None else g.dense(only.value))

        return _spread(sources).mapInArrow(shared, schema), None, None
    edges = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")), "edges")
    labels = written(connected_components(edges), "labels") if labels is None else labels
    mine = written(sources.select(F.col(sources.columns[0]).cast("long").alias("node")).distinct().join(labels.hint("merge"), "node"), "sources")
    inside = edges.join(labels.withColumnRenamed("node", "src").hint("merge"), "src")
    # of degrees: edges are not joined to be counted
    size = labels.join(degrees(edges).hint("merge"), "node").groupBy("component").agg(F.sum("deg").alias("edges"), F.count(F.lit(1)).alias("nodes"))
    size = size.join(mine.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    size = written(size.select("component", "edges", F.ceil(F.col("n") * (F.col("edges") + F.col("nodes")) / F.lit(WORK)).cast("int").alias("blocks")), "parts")
    small, large = size.filter(F.col("edges") <= MOST_PART_EDGES), size.filter(F.col("edges") > MOST_PART_EDGES)
    tasks = (small.agg(F.sum("blocks")).first()[0] or 0) // 2 + 4 * max(edges.sparkSession.sparkContext.defaultParallelism, 1)

    def rows(of: DataFrame, block: Column, kind: int, a: str, b: str) -> DataFrame:
        return of.join(small.hint("merge"), "component").select("component", block.alias("block"), F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))

    some = targets is not None
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows(inside, every, EDGE, "src", "dst").unionByName(rows(mine, F.pmod(F.xxhash64("node"), "blocks").cast("int"), SOURCE, "node", "node"))
    if some:
        dealt = dealt.unionByName(rows(targets.join(labels.hint("merge"), "node"), every, TARGET, "node", "node"))
    dealt = dealt.repartition(min(tasks, MOST_TASKS), "component", "block").sortWithinPartitions("component", "block")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kind, a, b in _whole_parts(batches):
            here = kind == EDGE
            g = Adjacency(a[here], b[here], part[here])
            yield from run(g, g.dense(a[kind == SOURCE]), g.dense(a[kind == TARGET]) if some else None)

    made = dealt.mapInArrow(own, schema)
    if large.isEmpty():
        return made, None, None
    rest = inside.join(large.hint("merge"), "component", "left_semi").select("src", "dst")
    return made, rest, mine.join(large.hint("merge"), "component", "left_semi").select(F.col("node").alias("source"))


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, kind, a, b) of sorted rows (component, block, kind, a, b): whole parts, about ``HELD`` rows of them together.

    Blocks of one component, which share nodes, are never together.
    """
    held: list[pa.RecordBatch] = []

    def made(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        c, k, *columns = (x.to_numpy() for x in pa.Table.from_batches(rows).columns)
        again = np.flatnonzero((np.diff(k) != 0) & (np.diff(c) == 0)) + 1
        part = np.cumsum(np.diff(c, prepend=c[0]) != 0)
        for lo, hi in zip([0, *again.tolist()], [*again.tolist(), len(c)], strict=True):
            yield part[lo:hi], *(x[lo:hi] for x in columns)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD:
            c, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            begins = np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1
            if len(begins):
                last = int(begins[-1])
                yield from made([*held[:-1], b.slice(0, last)])
                held = [b.slice(last)]
    if held:
        yield from made(held)


def bfs(edges: DataFrame, sources: DataFrame, plan: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(source, node, d, sigma, parent) of every reached node; the parent is the first discoverer in queue order.

    Unreached nodes have no row. ``sources`` has the source ids in its first column. ``labels``: written components, if known.
    """

    def run(g: Adjacency, starts: np.ndarray, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for s in g.searches(starts):
            slots = s.queue()
            parent = s.parent[slots]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g.ids[s.source[slots]]),
                    pa.array(g.ids[s.place[slots]]),
                    pa.array(s.dist[slots]),
                    pa.array(s.sigma[slots]),
                    pa.array(g.ids[s.place[np.maximum(parent, 0)]], mask=parent < 0),
                ],
                ["source", "node", "d", "sigma", "parent"],
            )

    made, rest, starts = _traversed(edges, sources, run, "source long, node long, d int, sigma double, parent long", plan, labels=labels)
    if rest is None:
        return made
    found = _bfs_joins(rest, starts)
    return found if made is None else made.unionByName(found)


def _bfs_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    nodes = edges.select("src").distinct()
    now = sources.join(nodes, F.col("source") == F.col("src"), "left_semi").select(
        "source", F.col("source").alias("node"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma"), F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("rank")
    )
    now = written(now, "level")
    levels = [now]
    for d in range(1, MOST_LEVELS + 1):
        seen = now if d == 1 else now.select("source", "node").unionByName(levels[-2].select("source", "node"))
        step = (
            now.select("source", F.col("node").alias("src"), "sigma", "rank")
            .join(edges, "src")
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.sum("sigma").alias("sigma"), F.min_by("src", "rank").alias("parent"), F.min("rank").alias("__r"))
            .join(seen.select("source", "node"), ["source", "node"], "left_anti")
        )
        queue = Window.partitionBy("source").orderBy("__r", "node")
        now = written(
            step.select("source", "node", F.lit(d).alias("d"), "sigma", "parent", F.row_number().over(queue).cast("long").alias("rank")), "level"
        )
        if now.isEmpty():
            break
        levels.append(now)
    else:
        raise RuntimeError(f"more than {MOST_LEVELS} levels")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.drop("rank")


def dependencies(edges: DataFrame, sources: DataFrame, plan: str | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, delta) of every reached node but the source; of ``targets`` (ids in the first column) only, if given."""
    wanted = None if targets is None else targets.select(F.col(targets.columns[0]).cast("long").alias("node")).distinct()

    def run(g: Adjacency, starts: np.ndarray, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if only is not None:
            among = np.zeros(len(g.ids), bool)
            among[only] = True
        for s in g.searches(starts):
            delta = s.dependencies()
            slots = np.flatnonzero(s.dist > 0 if only is None else (s.dist > 0) & among[s.place])
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[s.source[slots]]), pa.array(g.ids[s.place[slots]]), pa.array(delta[slots])], ["source", "node", "delta"])

    made, rest, starts = _traversed(edges, sources, run, "source long, node long, delta double", plan, wanted)
    if rest is None:
        return made
    found = _dependencies_joins(rest, starts)
    found = found if wanted is None else found.join(wanted, "node", "left_semi").select("source", "node", "delta")
    return found if made is None else made.unionByName(found)


def _dependencies_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    reached = written(bfs(edges, sources, "joins").select("source", "node", "d", "sigma"), "reached")
    deepest = reached.agg(F.max("d")).first()[0] or 0
    below = written(reached.filter(F.col("d") == deepest).select("source", "node", "sigma", F.lit(0.0).alias("delta")), "delta")
    done = [below]
    for d in range(deepest - 1, 0, -1):
        here = reached.filter(F.col("d") == d)
        share = (
            below.select("source", F.col("node").alias("src"), F.col("sigma").alias("sw"), "delta")
            .join(edges, "src")
            .join(here.select("source", F.col("node").alias("dst"), F.col("sigma").alias("sv")), ["source", "dst"])
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("delta"))).alias("delta"))
        )
        below = written(here.join(share, ["source", "node"], "left").select("source", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "delta")
        done.append(below)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.join(reached.filter("d > 0"), ["source", "node"], "left_semi").select("source", "node", "delta")


def betweenness(edges: DataFrame, plan: str | None = None, most_nodes: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(node, bc): exact, each unordered pair of end points counted once.

    ``most_nodes`` is a guard: more nodes than that raise. With the broadcast plan a task adds up its sources, so that
    a row per node and task is shuffled, not one per pair of nodes. ``labels``: written components, if known.
    """
    nodes = edges.select(F.col("src").alias("node")).distinct()
    if most_nodes is not None and nodes.limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes: use an estimate")

    def run(g: Adjacency, starts: np.ndarray, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if len(starts):
            yield pa.RecordBatch.from_arrays([pa.array(g.ids), pa.array(g.totals(starts))], ["node", "delta"])

    part, rest, starts = _traversed(edges, nodes, run, "node long, delta double", plan, labels=labels)
    if rest is not None:
        # a block of sources at a time, added up before the next: what is written at once is a row for each node and source of a block
        starts = written(starts, "sources")
        total = starts.count()
        blocks = max(1, math.ceil(total * total / MOST_REACHED))
        for block in range(blocks):
            mine = starts.filter(F.pmod(F.xxhash64("source"), F.lit(blocks)) == block)
            sums = written(_dependencies_joins(rest, mine).groupBy("node").agg(F.sum("delta").alias("delta")), "block")
            part = sums if part is None else part.unionByName(sums)
    sums = part.groupBy("node").agg((F.sum("delta") / 2).alias("bc"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("bc", F.lit(0.0)).alias("bc"))


def level_statistics(reached: DataFrame, degrees: DataFrame) -> DataFrame:
    """(source, d, size, avg_deg) with the mean degree of a level, at least 1.01 where it is below 1."""
    a = F.avg("deg")
    return reached.join(degrees, "node").groupBy("source", "d").agg(F.count(F.lit(1)).alias("size"), F.when(a < 1, F.lit(1.01)).otherwise(a).alias("avg_deg"))


def pair_distances(edges: DataFrame, pairs: DataFrame, cap: int = 50) -> DataFrame:
    """pairs (u, v) with their distance, at most ``cap``; unconnected pairs get ``cap``."""
    reached = bfs(edges, pairs.select("u")).select(F.col("source").alias("u"), F.col("node").alias("v"), "d")
    return pairs.join(reached, ["u", "v"], "left").select(*pairs.columns, F.least(F.coalesce("d", F.lit(cap)), F.lit(cap)).alias("d"))


def diameter_estimate(edges: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """One row: the greatest eccentricity of ``k`` nodes chosen by a draw on their ids, at least 1."""
    from ..functions.draws import key, uniform

    nodes = edges.select(F.col("src").alias("node")).distinct()
    chosen = nodes.orderBy(uniform(key(F.col("node"), seed=seed)), "node").limit(k)
    return bfs(edges, chosen).agg(F.greatest(F.coalesce(F.max("d"), F.lit(1)), F.lit(1)).alias("diameter"))


def eccentricity_estimate(edges: DataFrame, k: int = 5, graph: GraphOf = None, labels: DataFrame | None = None) -> DataFrame:
    """(node, ecc): the greatest distance to the ``k`` nodes of lowest id (of the graph); n if one is out of reach."""
    nodes = edges.select(F.col("src").alias("node")).distinct()
    if graph is not None:
        order = Window.partitionBy("graph").orderBy("node")  # filtered to k, which Spark does before it shuffles
        anchors = nodes.withColumn("graph", graph(F.col("node"))).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("node", "graph")
        far = bfs(edges, anchors.select("node"), labels=labels).groupBy("node").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("met"))
        of = nodes.withColumn("graph", graph(F.col("node")))
        n = of.groupBy("graph").agg(F.count(F.lit(1)).cast("int").alias("n"))
        n = n.withColumn("k", F.least(F.col("n"), F.lit(k)))
        return of.join(n, "graph").join(far, "node", "left").select("node", F.when(F.col("met") == F.col("k"), F.col("far")).otherwise(F.col("n")).alias("ecc"))
    anchors = nodes.orderBy("node").limit(k)
    reached = bfs(edges, anchors)
    n = nodes.agg(F.count(F.lit(1)).cast("int").alias("n"))
    far = reached.groupBy("node").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("met"))
    # one-row sides: n and the number of anchors
    one = n.join(anchors.agg(F.count(F.lit(1)).alias("k")))
    return nodes.join(far, "node", "left").join(F.broadcast(one)).select("node", F.when(F.col("met") == F.col("k"), F.col("far")).otherwise(F.col("n")).alias("ecc"))


def optimal_pivots(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, p): each source's share of the target's dependencies, the variance-free distribution."""
    nodes = edges.select("src").distinct()
    dep = dependencies(edges, nodes, targets=targets)
    share = F.col("delta") / F.sum("delta").over(Window.partitionBy("node"))
    return dep.filter(F.col("delta") > 0).select(F.col("node").alias("target"), F.col("source").alias("node"), share.alias("p"))
