"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed random rotation; cosine >= t means a squared distance of at most
2 - 2t. Of blocks of the rotated coordinates with budgets in proportion to their widths, one must keep its budget. Each
block is range-joined on its own: pivots cut its space into cells, a vector lives in the cell of its nearest pivot and
visits every other cell that its ball may reach (its distance to the hyperplane between the two pivots is at most the
radius). GROUP neighbouring cells travel together, so that a vector goes to each group once, and are told apart again
where they are compared. What one block finds is verified by the cosine of the original vectors in double precision, and
counted in the first block whose budget the pair keeps, so a link found in several blocks counts once.

Byte-equal vectors are one class with a count. Pairs are never emitted: a task gives the number of links of each class
and a star of edges of what it found connected. Groups of more than BLOCK classes are cut into chunks, each visited alike.

Classes are told by hashes of 64 bits of their vectors, whatever ids their rows have.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; shorter vectors count as if they ended in zeros; a null vec_id is a class member like any other, but
the component_id is null only where a component has no other id; rows with equal vec_ids stay separate rows, linked by
their own vectors alone; components of any finite size are fine; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged
from .vectors import batches_of, by_key, centres, nearest, sample, scaled, usable

#: Blocks, the fewest and the most cells of each (between them the root of the rows over 200), classes of a chunk of a
#: cell, visitors compared with a chunk at once, pivots' sample.
#: Blocks; the least and most cells of one; cells of a group; classes of a chunk; rows compared at once; rows that pivots are fitted on.
PARTS, CELLS, GROUP, BLOCK, AT_ONCE, SAMPLE = 4, (32, 256), 8, 8192, 1024, 8192


def neighbours_together(p: np.ndarray) -> np.ndarray:
    """The rows of p in an order in which every GROUP in a row lie near one another: halves along the widest axis."""
    order, todo = [], [np.arange(len(p))]
    while todo:
        own = todo.pop()
        if len(own) <= GROUP:
            order.append(own)
            continue
        own = own[p[own, p[own].var(axis=0).argmax()].argsort(kind="stable")]
        half = GROUP * -(-len(own) // (2 * GROUP))
        todo += [own[half:], own[:half]]
    return p[np.concatenate(order)]


class Subspaces:
    """The rotation, the blocks with their budgets and pivots."""

    def __init__(self, x: np.ndarray, threshold: float, parts: int, cells: int):
        self.width = x.shape[1]
        self.threshold = threshold
        self.rotation = np.linalg.qr(np.random.default_rng(17).normal(size=(self.width, self.width)))[0]
        edges = np.linspace(0, self.width, min(parts, self.width) + 1).astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.budgets = [(2 - 2 * threshold) * (b - a) / self.width * (1 + 1e-9) + 1e-12 for a, b in self.blocks]
        y = self.rotated(x)
        self.pivots = [neighbours_together(centres(y[:, a:b], cells)) for a, b in self.blocks]

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation  # x: scaled

    def homes(self, y: np.ndarray, j: int) -> np.ndarray:
        """The cell of each rotated row."""
        a, b = self.blocks[j]
        return nearest(y[:, a:b], self.pivots[j])

    def reach(self, y: np.ndarray, j: int, home: np.ndarray) -> np.ndarray:
        """Mask of the cells to visit, the own one included: of a pair of cells, members of the lower visit the higher."""
        a, b = self.blocks[j]
        p, part = self.pivots[j], y[:, a:b]
        d = np.maximum(0, (part * part).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * part @ p.T)
        own = np.arange(len(y))
        apart = np.sqrt(np.maximum(0, (p * p).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * p @ p.T))[home]
        reach = d - d[own, home][:, None] <= 2 * apart * (self.budgets[j] ** 0.5 + 1e-6) + 1e-9
        reach &= np.arange(len(p)) >= home[:, None]
        reach[own, home] = True
        return reach

    def first_block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first block whose budget each pair of rotated rows keeps."""
        kept = np.stack([((x[:, a:b] - y[:, a:b]) ** 2).sum(axis=1) <= budget for (a, b), budget in zip(self.blocks, self.budgets)])
        return kept.argmax(axis=0)


def linked(at: Subspaces, j: int, group: int, home: tuple, visitors: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Indices (visitor, home) of the links within one group of cells. Each side: (vectors, rotated, ids, cells)."""
    (hx, hy, hid, hc), (vx, vy, vid, vc) = home, visitors
    a, b = at.blocks[j]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    hn, vn = (hx * hx).sum(axis=1), (vx * vx).sum(axis=1)
    members = []
    for c in range(group * GROUP, min((group + 1) * GROUP, len(at.pivots[j]))):
        if len(own := np.flatnonzero(hc == c)):
            part = hy[own, a:b]
            members.append((c, own, np.concatenate([part, (part * part).sum(axis=1)[:, None], np.ones((len(own), 1))], axis=1).astype(np.float32).T.copy()))
    # Squared distances by one product, in single precision: of parts of unit vectors, so they err by less than 1e-5.
    most = np.float32(at.budgets[j] + 1e-5)
    for i in range(0, len(vx), AT_ONCE):
        part = vy[i : i + AT_ONCE, a:b]
        reach = at.reach(vy[i : i + AT_ONCE], j, vc[i : i + AT_ONCE])
        sides = np.concatenate([-2 * part, np.ones((len(part), 1)), (part * part).sum(axis=1)[:, None]], axis=1).astype(np.float32)
        for c, own, wide in members:
            who = np.flatnonzero(reach[:, c])
            if not len(who):
                continue
            u, v = np.divmod(np.flatnonzero(sides[who] @ wide <= most), len(own))
            u, v = who[u] + i, own[v]
            keep = (vc[u] != c) | (vid[u] < hid[v])
            u, v = u[keep], v[keep]
            for k in range(0, len(u), 1 << 14):
                uu, vv = u[k : k + (1 << 14)], v[k : k + (1 << 14)]
                near = np.einsum("ij,ij->i", vx[uu], hx[vv]) / np.sqrt(vn[uu] * hn[vv]) >= at.threshold
                near[near] = at.first_block(vy[uu[near]], hy[vv[near]]) == j
                left.append(uu[near])
                right.append(vv[near])
    return np.concatenate(left), np.concatenate(right)


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges (u, v)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def link(vectors: DataFrame, threshold: float = 0.9, parts: int = PARTS, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id) of every row; vectors: (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fit = usable(F.col("embedding"))
    keyed = rows.withColumn("h1", F.when(fit, F.xxhash64("embedding"))).withColumn("h2", F.when(fit, F.xxhash64(F.lit(1), "embedding")))
    classes = staged(keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")).withColumn("class", F.col("h1")), "vector-classes")
    width, n_classes = classes.agg(F.max(F.size("embedding")), F.count("*")).first()
    cells = cells or min(max(round((n_classes / 200) ** 0.5), CELLS[0]), CELLS[1])
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    picked = sample(classes, SAMPLE)
    at = Subspaces(scaled(np.pad(picked, ((0, 0), (0, width - picked.shape[1])))), threshold, parts, cells)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = at.rotated(scaled(batches_of(b.column(0), width)))
                groups = np.concatenate([at.homes(y, j) // GROUP for j in range(len(at.blocks))])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(at.blocks)), len(y))), pa.array(groups)], ["block", "group"])

    sizes = {(r["block"], r["group"]): r["n"] for r in classes.select("embedding").mapInArrow(homes, "block long, group long").groupBy("block", "group").agg(F.count("*").alias("n")).collect()}
    chunks = np.ones((len(at.blocks), -(-max(len(p) for p in at.pivots) // GROUP)), np.int64)
    for (j, g), n in sizes.items():
        chunks[j, g] = -(-n // BLOCK)

    schema = "block long, group long, chunk long, side long, class long, copies long, home long, vector binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "group", "chunk", "side", "class", "copies", "home", "vector"]
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(i, AT_ONCE)
                x = scaled(batches_of(b.column(2), width))
                ids, copies, y = b.column(0).to_numpy(), b.column(1).to_numpy(), at.rotated(x)
                raw = np.array([r.tobytes() for r in x], object)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for j in range(len(at.blocks)):
                    home = at.homes(y, j)
                    own, mine = mixed % chunks[j, home // GROUP], np.arange(len(x))
                    reach = at.reach(y, j, home)
                    who, group = np.nonzero(np.logical_or.reduceat(reach, np.arange(0, reach.shape[1], GROUP), axis=1))
                    times = chunks[j, group]
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, group = np.repeat(who, times), np.repeat(group, times)
                    # Members of a chunk meet one another there.
                    away = (group != home[who] // GROUP) | (nth != own[who])
                    who, group, nth = who[away], group[away], nth[away]
                    take = np.concatenate([mine, who])
                    columns = [np.full(len(take), j), np.concatenate([home // GROUP, group]), np.concatenate([own, nth]), np.repeat([0, 1], [len(mine), len(who)]), ids[take], copies[take], home[take]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(raw[take].tolist(), pa.binary())], names)

    def sides(parts: list[pa.RecordBatch]) -> tuple:
        x = np.concatenate([np.frombuffer(b"".join(p.column(7).to_pylist()), np.float64).reshape(-1, width) for p in parts])
        return (x, at.rotated(x), *(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (4, 6, 5)))

    def met(j: int, group: int, home: tuple, visitors: tuple) -> Iterator[pa.RecordBatch]:
        u, v = linked(at, j, group, home[:4], visitors[:4])
        if not len(u):
            return
        n, ids = len(visitors[2]), np.concatenate([visitors[2], home[2]])
        links = np.concatenate([np.bincount(u, home[4][v], n), np.bincount(v, visitors[4][u], len(home[2]))]).astype(np.int64)
        root = stars(u, v + n, len(ids))
        some, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[some], ids[far]])), pa.array(np.concatenate([links[some], np.zeros(len(far), np.int64)])), pa.array([None] * len(some) + ids[root[far]].tolist(), pa.int64())], ["class", "links", "other"]
        )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, home = (-1, -1, -1), [], None
        for (*now, side), _, part in by_key(batches, 4):
            if tuple(now) != key:
                if held:
                    home = sides(held)
                    yield from met(*key[:2], home, home)
                key, held, home = tuple(now), [], None
            if side == 0:
                held.append(part)
                continue
            if held:
                home, held = sides(held), []
                yield from met(*key[:2], home, home)
            if home is not None:  # else a chunk without members of its own
                yield from met(*key[:2], home, sides([part]))
        if held:
            home = sides(held)
            yield from met(*key[:2], home, home)

    dealt = classes.select("class", "copies", "embedding").mapInArrow(deal, schema)
    found = staged(dealt.repartition("block", "group", "chunk").sortWithinPartitions("block", "group", "chunk", "side").mapInArrow(join, "class long, links long, other long"), "vector-links")
    roots = components(found.where("other is not null").select(F.col("class").alias("u"), F.col("other").alias("v")))
    counted = found.where("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("h1", "h2", "class", "copies", "first_id").join(counted, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = known.select("h1", "h2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least"))
    named = named.join(least, "root").select("h1", "h2", "n", "least")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return keyed.join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
