"""Near-duplicate vectors of one label by dual traversal of cover trees.

1.  Exact copies meet as one class with a count.
2.  Vectors of a crowded label go to the nearest of a bounded number of pivots,
    the top level of the label's tree. Cells with covering radii a and b and
    pivots further apart than a + b + eps share no link, and a vector is sent
    to another cell only if it is within that cell's radius + eps of its pivot.
    A cell that is too large for a task is dealt into blocks, and each pair of
    blocks is a task, so that every pair of vectors is looked at in one place.
3.  A task builds a cover tree of each side (levels of halving radii) and walks
    pairs of nodes, dropping those that their radii rule out. Pairs that are
    left are tested exactly, in double precision.
4.  A task returns the sums of its links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, sorted_runs
from .components import connected_components

THRESHOLD = 0.98
#: Members of a block, and of a leaf of a tree.
BLOCK, LEAF = 2048, 32
#: Labels that get pivots (the largest), and pivots of a label, at most; other crowded labels are dealt into blocks at once.
PIVOT_LABELS, PIVOTS = 64, 64
SLACK = 1e-6


class Node:
    """Points of a cover tree node, its centre's place and its covering radius."""

    __slots__ = ("points", "centre", "radius", "children", "centres", "radii")

    def __init__(self, points, centre, radius):
        self.points, self.centre, self.radius, self.children = points, centre, radius, []


def cover_tree(unit, points, centre: int, radius: float, scale: float = 1.0) -> Node:
    """The tree over ``points`` (places in ``unit``, rows of length one); children are balls of ``scale``, then half of it, and so on."""
    import numpy as np

    node = Node(points, centre, radius)
    if len(points) <= LEAF or radius < 1e-7:
        return node
    left = points
    while len(left):
        c = int(left[0])
        d = np.sqrt(np.maximum(2 - 2 * (unit[left] @ unit[c]), 0))
        near = d <= scale
        own = left[near]
        node.children.append(cover_tree(unit, own, c, float(d[near].max()), scale / 2))
        left = left[~near]
    node.centres = np.array([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


class Links:
    """Sums of weights over links, and a spanning forest of them."""

    def __init__(self, weights):
        import numpy as np

        self.weights, self.sums, self.label, self.forest = weights, np.zeros(len(weights)), np.arange(len(weights)), []

    def add(self, i, j) -> None:
        import numpy as np

        np.add.at(self.sums, i, self.weights[j])
        np.add.at(self.sums, j, self.weights[i])
        a, b = self.label[i], self.label[j]
        if (a == b).all():
            return
        parent: dict[int, int] = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        for x, y in np.unique(np.stack([a, b], 1)[a != b], axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.forest.append((max(x, y), min(x, y)))
        for x in list(parent):
            self.label[self.label == x] = find(x)


def dual(a: Node, b: Node, unit, raw, norms, threshold: float, links: Links) -> None:
    """All links between the points of two trees, or within one if they are the same."""
    import numpy as np

    eps = math.sqrt(2 - 2 * threshold) + SLACK
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            i, j = a.points, b.points
            cos = (raw[i] @ raw[j].T) / (norms[i][:, None] * norms[j][None, :])
            hit = cos >= threshold
            if a is b:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            if len(x):
                links.add(i[x], j[y])
            continue
        own = a is b
        if not a.children or (b.children and b.radius > a.radius):
            a, b = b, a
        kids = b.children or [b]
        centres = b.centres if b.children else np.array([b.centre])
        radii = b.radii if b.children else np.array([b.radius])
        if not own:  # descend one side, the wider
            kids, centres, radii = [b], np.array([b.centre]), np.array([b.radius])
        d = np.sqrt(np.maximum(2 - 2 * (unit[a.centres] @ unit[centres].T), 0))
        keep = d <= a.radii[:, None] + radii[None, :] + eps
        if own:
            keep = np.triu(keep)
        stack.extend((a.children[x], kids[y]) for x, y in zip(*np.nonzero(keep)))


def _unit(flat, n: int):
    import numpy as np

    raw = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    # Components far from 1 would over- or underflow when squared.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    norms = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    return raw, norms, raw / norms[:, None]


def _homes(classes: DataFrame, pivots: dict) -> DataFrame:
    """``cid, label, embedding, n`` with ``home`` (the cell) and ``far`` (the distance to its pivot), and ``ds``, distances to all pivots of the label."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            labels = b.column(1).to_pylist()
            vectors = b.column(2)
            home, far, ds = [0] * len(labels), [0.0] * len(labels), [None] * len(labels)
            by: dict = {}
            for i, x in enumerate(labels):
                by.setdefault((x, len(vectors[i])), []).append(i)
            for key, rows in by.items():
                if key not in pivots:
                    continue
                _, _, unit = _unit(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), len(rows))
                d = np.sqrt(np.maximum(2 - 2 * (unit @ pivots[key].T), 0))
                for i, own in zip(rows, d):
                    home[i] = int(own.argmin())
                    far[i] = float(own[home[i]])
                    ds[i] = own.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(far, pa.float64()), pa.array(ds, pa.list_(pa.float64()))], names=[*b.schema.names, "home", "far", "ds"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{fields}, home int, far double, ds array<double>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, pivot_labels: int = PIVOT_LABELS, max_pivots: int = PIVOTS) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and their cosine, in double
    precision, is at least ``threshold``. Null labels, and vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. ``n_links`` counts the other rows
    linked directly, exact copies among them. Rows with a null id link but name
    no component. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Exact copies are told by two hashes of label and vector, 128 bits together: vectors themselves aren't shuffled for it.
    keys = [F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding", "label").alias("k2")]
    good = materialize(rows.filter("fine").select("vec_id", *keys, F.monotonically_increasing_id().alias("row")), "vector_keys")
    classes = rows.filter("fine").select("*", *keys).groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "label", "embedding", "n", "first_id"), "vector_classes")
    names = classes.select("cid", F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("cid")).alias("label"))

    size = F.size("embedding").alias("dim")
    counted = classes.groupBy("label", size).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block)
    crowded = counted.orderBy(F.col("m").desc(), "label", "dim").limit(pivot_labels).collect()
    pivots = {}
    for label, dim, m in crowded:  # the pivots are of a bounded number, by the hash of the vector
        k = min(max_pivots, -(-m // block))
        own = classes.filter((F.col("label") == label) & (F.size("embedding") == dim)).orderBy(F.xxhash64("embedding"), "cid").limit(k).select("embedding").collect()
        pivots[(label, dim)] = _unit([x for r in own for x in r[0]], len(own))[2]
    housed = materialize(_homes(classes.select("cid", "label", "embedding", "n"), pivots), "housed_vectors")
    cells = materialize(housed.groupBy("label", size, "home").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("radius")), "cells")
    of_pivots = {(r["label"], r["dim"], r["home"]): (r["m"], r["radius"]) for r in cells.filter(F.col("label").isin([k[0] for k in pivots])).collect() if (r["label"], r["dim"]) in pivots} if pivots else {}
    eps = math.sqrt(2 - 2 * threshold) + SLACK
    # Blocks of each cell; cells of labels without pivots come from the join.
    parted = housed.withColumn("dim", F.size("embedding")).join(cells.filter(F.col("m") > block).select("label", "dim", "home", F.ceil(F.col("m") / block).cast("int").alias("parts")), ["label", "dim", "home"], "left").fillna({"parts": 1})
    parted = parted.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))

    def deal(batches):
        """A row for each task that the vector takes part in: cells and blocks of both sides in order."""
        import pyarrow as pa

        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n not in ("embedding",)}
            row, task, side = [], [], []
            for i, (label, dim, home, ds, parts, own) in enumerate(zip(*(col[n] for n in ("label", "dim", "home", "ds", "parts", "own")))):
                for p in range(parts):
                    lo, hi = min(own, p), max(own, p)
                    row.append(i)
                    task.append(f"{label}:{dim}:{home}:{home}:{lo}:{hi}")
                    side.append(0 if own == lo else 1)
                for other, d in enumerate(ds or ()):
                    if other == home or (label, dim, other) not in of_pivots:
                        continue
                    m, radius = of_pivots[(label, dim, other)]
                    if d > radius + eps:
                        continue
                    for p in range(-(-m // block)):
                        first = home < other
                        row.append(i)
                        task.append(f"{label}:{dim}:{home}:{other}:{own}:{p}" if first else f"{label}:{dim}:{other}:{home}:{p}:{own}")
                        side.append(0 if first else 1)
            taken = b.select(["cid", "n", "embedding"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.string()), pa.array(side, pa.int8()), *taken.columns], names=["task", "side", "cid", "n", "embedding"])

    kind = dict(classes.dtypes)["embedding"]
    tasks = parted.select("label", "dim", "home", "ds", "parts", "own", "cid", "n", "embedding").mapInArrow(deal, f"task string, side byte, cid long, n long, embedding {kind}")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table in sorted_runs(batches, "task"):
            side = table.column("side").to_numpy()
            home, other, lo, hi = table.column("task")[0].as_py().split(":")[-4:]
            self_join = home == other and lo == hi
            if table.num_rows < 2:
                continue
            cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy().astype(float)
            raw, norms, unit = _unit(pa.concat_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in table.column("embedding").chunks]).flatten().to_numpy(zero_copy_only=False), len(cid))
            links = Links(n)
            trees = []
            for own in ((np.arange(len(cid)),) if self_join else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))):
                if len(own):
                    d = np.sqrt(np.maximum(2 - 2 * (unit[own] @ unit[own[0]]), 0))
                    trees.append(cover_tree(unit, own, int(own[0]), float(d.max())))
            if not self_join and len(trees) < 2:
                continue
            dual(trees[0], trees[-1], unit, raw, norms, threshold, links)
            some = np.flatnonzero(links.sums)
            a = [*cid[some].tolist(), *(int(cid[x]) for x, _ in links.forest)]
            b = [*[None] * len(some), *(int(cid[y]) for _, y in links.forest)]
            s = [*links.sums[some].astype(np.int64).tolist(), *[0] * len(links.forest)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], names=["a", "b", "links"])

    found = materialize(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long, links long"), "vector_links")
    sums = found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    # A class's name starts with its least id, so that a component's least name is the component's.
    edges = found.filter("b IS NOT NULL").select("a", "b")
    for side in ("a", "b"):
        edges = edges.join(names.select(F.col("cid").alias(side), F.col("label").alias(f"{side}_name")), side)
    roots = connected_components(edges, "a_name", "b_name").select(F.col("node.cid").alias("cid"), F.col("root.id").alias("root_id"), F.lit(True).alias("linked"))
    named = classes.drop("label", "embedding").join(sums, "cid", "left").join(roots, "cid", "left")
    named = named.select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("first_id")).alias("component_id"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(good, named, ["k1", "k2"], "n", total, "row").select("vec_id", "n_links", "component_id")
    rest = rows.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
