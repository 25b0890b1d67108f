"""Near-duplicate documents by SimHash fingerprints and BK-trees.

1.  A fingerprint per document, in Arrow batches.
2.  Distinct fingerprints only: exact copies, however many, meet as one row.
3.  The 64 bits are cut into blocks, so many that two fingerprints within the
    radius agree on some choice of ``blocks - radius`` of them. Each choice with
    its bits names a shard; more blocks are taken when there are more
    fingerprints, so that a shard of evenly spread ones keeps about 64 members.
4.  Each shard is a BK-tree. A shard that is crowded all the same is dealt into
    parts of about ``max_part`` members, and each part's tree is sent to the
    tasks of every part of the same shard (by the shuffle: a Spark broadcast of
    all trees would grow with the corpus, without bound).
5.  A shard returns stars that join what its links join, never all pairs;
    components are then found over them.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, sorted_runs
from .components import connected_components

RADIUS = 4
SHARD_MEMBERS = 64
MAX_PART = 1024


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text; 0 where there are no words.

    A-Z are lower-cased; words are parted by ASCII white space; each shingle of
    ``size`` words, repeats included, votes with its XXH64; fewer words form one shingle.
    """
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
    # Counts of each byte value at each of the eight places, then of each bit.
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    bits = counts @ (np.arange(256)[:, None] >> np.arange(8) & 1)
    return int(np.packbits(2 * bits.ravel() > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for each row, null and empty texts included."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Integers by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        node = self.root
        if node is None:
            self.root = (value, {})
            return
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Members at most ``radius`` away; only edges that can lead to one are followed."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            member, children = stack.pop()
            d = (member ^ value).bit_count()
            if d <= radius:
                found.append(member)
            low, high = d - radius, d + radius
            stack.extend(child for key, child in children.items() if low <= key <= high)
        return found


def _stars(tree_values: list[int], query_values: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Places (in the tree's values, then the queries') of a component's first member and of each other one, for the components of the links; without ``query_values`` among the tree's own members."""
    values = tree_values + (query_values or [])
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree, place = BKTree(), {}
    if query_values is not None:
        for i, v in enumerate(tree_values):
            tree.add(v)
            place[v] = i
    for i in range(len(tree_values) if query_values is not None else 0, len(values)):
        for m in tree.within(values[i], radius):
            a, b = find(i), find(place[m])
            parent[max(a, b)] = min(a, b)
        if query_values is None:
            tree.add(values[i])
            place[values[i]] = i
    return [(r, i) for i in range(len(values)) if (r := find(i)) != i]


def _choices(n: int, radius: int, members: int) -> list[list[tuple[int, int]]]:
    """For each shard table the (shift, width) of the blocks that its members share."""
    for blocks in range(radius + 1, radius + 5):
        cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
        parts = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
        chosen = list(itertools.combinations(parts, blocks - radius))
        if n >> min(sum(w for _, w in c) for c in chosen) <= members:
            break
    return [list(c) for c in chosen]


def links(nodes: DataFrame, n: int, radius: int = RADIUS, members: int = SHARD_MEMBERS, max_part: int = MAX_PART) -> DataFrame:
    """``a, b``: pairs of ``label`` that join all of the ``n`` rows with distinct ``fp`` that chains of steps of ``radius`` bits join."""
    fp = F.col("fp")
    keys = []
    for blocks in _choices(n, radius, members):
        key = F.lit(0).cast("long")
        for shift, width in blocks:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1))
        keys.append(key)
    rows = nodes.select("label", "fp", F.posexplode(F.array(*keys)).alias("t", "k"))
    crowded = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_part)
    rows = rows.join(crowded, ["t", "k"], "left").withColumn("parts", F.ceil(F.coalesce(F.col("n"), F.lit(1)) / max_part).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other).select(
        F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "t", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("in_tree"), "fp", "label"
    )

    def run(batches):
        import pyarrow as pa

        for table in sorted_runs(batches, "shard"):
            if table.num_rows < 2:
                continue
            # The shard's name is a hash: rows of two shards that collide are told apart here.
            shards: dict = {}
            for i, (t, k, p, q, in_tree, v) in enumerate(zip(*(table.column(c).to_pylist() for c in ("t", "k", "p", "q", "in_tree", "fp")))):
                shards.setdefault((t, k, p, q), ([], []))[0 if in_tree else 1].append((v & 0xFFFFFFFFFFFFFFFF, i))
            found = []
            for (_, _, p, q), (tree, query) in shards.items():
                at = [i for _, i in tree + query]
                found += [(at[x], at[y]) for x, y in _stars([v for v, _ in tree], None if p == q else [v for v, _ in query], radius)]
            if found:
                label = table.column("label").combine_chunks()
                yield pa.RecordBatch.from_arrays([label.take(pa.array(side)) for side in zip(*found)], names=["a", "b"])

    kind = nodes.schema["label"].dataType.simpleString()
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = RADIUS, max_part: int = MAX_PART, similarity: float | None = None, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, fp, fingerprint, component_id``.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the least
    doc_id among all documents that steps of at most ``radius`` differing bits
    reach, the document itself included. Null and empty texts have fingerprint
    zero and link like any other. Rows with a null doc_id link too but name no
    component (it is null only if all of its rows have none). Repeated rows stay
    repeated. Extra columns are ignored. An empty table gives an empty result.

    With ``similarity`` documents link by that similarity of their sets of
    shingles instead: see similar.near_duplicates, which ``row_col`` is for.
    """
    if similarity is not None:
        from . import similar

        return similar.near_duplicates(docs, id_col, text_col, size, similarity, row_col, max_part)
    fps = materialize(fingerprints(docs, id_col, text_col, size).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    # A fingerprint's label starts with its least document, so that a component's least label names the component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    distinct = fps.groupBy("fp").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).select("fp", "n", F.struct("f.none", "f.id", "fp").alias("label"))
    distinct = materialize(distinct, "distinct_fingerprints")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = connected_components(links(distinct, n, radius, max_part=max_part)).withColumnRenamed("node", "label")
    named = distinct.join(roots.hint("merge"), "label", "left").select("fp", "n", F.coalesce("root", "label").id.alias("component_id"))
    found = join_hot(fps, named, ["fp"], "n", total, "row")
    return found.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
