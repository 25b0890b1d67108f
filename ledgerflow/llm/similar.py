"""SimHash near-dedup at a similarity of shingle sets: wide fingerprints, BK-trees, and a check on the texts.

A similarity of 0.8 is a long way in fingerprint bits, too long for shards by
blocks of equal bits. So fingerprints have 256 bits, shards are named by bands
of min-wise hashes (two documents share one if their sets are alike), and each
shard's members meet in BK-trees whose radius holds a similarity of ``least``.

1.  Each document is the set of its shingles. Equal sets meet as one node.
2.  Buckets of one member go at once; a crowded one is dealt into parts.
3.  First each part picks leaders: members in order of their distance to the
    majority fingerprint look for a leader in the tree and become one if none
    is near. Leaders of a crowded bucket's parts then do the same together.
    Pairs of a member and its leader are checked on their whole texts.
4.  What that leaves apart within a bucket is looked up, in a second pass, in
    trees against all of the bucket, and compared in the tasks that hold both
    texts. Links come out of it, no rows of pairs. No link between candidates
    is lost, and a group of copies of one text isn't compared pair by pair.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, sorted_runs
from .components import connected_components

SIZE = 5
LEAST = 0.8
BITS = 256
#: A pair at 0.8 shares no band with a probability of (1 - 0.8 ** 4) ** 20 = 3e-5.
BANDS, ROWS = 20, 4
MAX_PART = 1024
#: Texts that a task compares with one leader's, and shingles that are worked on at once.
CHECKS, STEP = 512, 4096
#: Sets of fewer shingles than this get twice the slack in the radius.
FEW = 32
CACHED_WORDS, LONG_WORD = 200_000, 64

_C1, _C2, _PRIME = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15


class Words(dict):
    """Hashes of words; short ones are kept, so many at most."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


_words = Words()


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(_C1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_C2)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, size: int = SIZE):
    """Sorted distinct 64-bit hashes of the shingles, with words as in simhash.fingerprint."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.array([], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_PRIME) + h[k : k + n]
    return np.unique(_mixed(out))


def fingerprint(hashes, bits: int = BITS) -> bytes:
    """SimHash of distinct shingles: a bit is set if over half of them have it."""
    import numpy as np

    if not len(hashes):
        return bytes(bits // 8)
    places, bit_of, ones = np.arange(8) * 256, np.arange(256)[:, None] >> np.arange(8) & 1, []
    for i in range(bits // 64):
        counts = np.zeros(2048, np.int64)
        for at in range(0, len(hashes), STEP):
            part = hashes[at : at + STEP]
            h = _mixed(part + np.uint64((i * _PRIME) & 0xFFFFFFFFFFFFFFFF))
            counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + places).ravel(), minlength=2048)
        ones.append((counts.reshape(8, 256) @ bit_of).ravel())
    return np.packbits(2 * np.concatenate(ones) > len(hashes)).tobytes()


def jaccard(a, b) -> float:
    """Of two sorted arrays without repeats; two empty ones are equal."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def radius(least: float, bits: int = BITS, slack: float = 4.4) -> int:
    """Bits in which fingerprints of two sets at a similarity of ``least`` differ, with ``slack`` standard deviations."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return round(bits * share + slack * math.sqrt(bits * share * (1 - share)))


def _signatures(rows: DataFrame, size: int) -> DataFrame:
    """``row, doc_id``, ``s1, s2`` (name the set), ``size``, ``fp`` and ``bands`` for ``row, doc_id, text``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        draw = np.random.default_rng(42)
        flip, times = (draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
        times |= np.uint32(1)
        weights = draw.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
        for b in batches:
            names, sizes, fps, bands = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text, size)
                names.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                fps.append(fingerprint(h))
                if len(h):
                    low = (h >> np.uint64(32)).astype(np.uint32)
                    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint64)
                    for i in range(0, len(low), STEP):
                        least = np.minimum(least, ((low[i : i + STEP] ^ flip) * times).min(axis=1))
                    keys = _mixed((least.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64))
                    bands.append(keys.view(np.int64))
                else:
                    bands.append([])
            named = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(named[:, 0].copy()), pa.array(named[:, 1].copy()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["row", "doc_id", "s1", "s2", "size", "fp", "bands"],
            )

    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, s1 long, s2 long, size int, fp binary, bands array<long>")


class Near:
    """Whether members may be similar, by the sizes of their sets and by their fingerprints."""

    def __init__(self, least: float):
        self.least, self.far, self.wide = least, radius(least), radius(least, slack=8.8)

    def search(self, size: int) -> int:
        return self.far if size >= FEW / self.least else self.wide

    def may(self, x: int, y: int, n: int, m: int) -> bool:
        few, many = min(n, m), max(n, m)
        return few >= self.least * many and (x ^ y).bit_count() <= (self.far if few >= FEW else self.wide)


def leaders(fps: list[bytes], sizes: list[int], near: Near) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of a leader's place and a member's that is near it, and all leaders' places."""
    import numpy as np

    from .simhash import BKTree

    values = [int.from_bytes(f, "big") for f in fps]
    if len(values) == 2:
        return ([(0, 1)], [0]) if near.may(*values, *sizes) else ([], [0, 1])
    bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)
    order = np.argsort((bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(fps))).sum(axis=1), kind="stable").tolist()
    tree, at, pairs = BKTree(), {}, []
    for i in order:
        v, n = values[i], sizes[i]
        close = [(((m ^ v).bit_count()), j) for m in tree.within(v, near.search(n)) for j in at[m] if near.may(v, m, n, sizes[j])]
        if close:
            pairs.append((min(close)[1], i))
        elif v in at:
            at[v].append(i)
        else:
            tree.add(v)
            at[v] = [i]
    return pairs, [j for js in at.values() for j in js]


def _led(members: DataFrame, max_part: int, least: float) -> DataFrame:
    """``a, b``: a leader's label and a member's; with null ``b``, and ``k, fp, size``, the leaders of crowded buckets."""
    parts = F.ceil(F.col("n") / max_part)
    dealt = members.withColumn("task", F.xxhash64("k", F.pmod(F.xxhash64("label"), parts)))
    near = Near(least)

    def run(batches):
        import pyarrow as pa

        for t in sorted_runs(batches, "task"):
            pairs, heads = leaders(t.column("fp").to_pylist(), t.column("size").to_pylist(), near) if t.num_rows > 1 else ([], [0])
            heads = heads if t.column("n")[0].as_py() > max_part else []
            label = t.column("label").combine_chunks()
            first = pa.array([a for a, _ in pairs] + heads, pa.int64())
            second = pa.array([b for _, b in pairs] + [None] * len(heads), pa.int64())
            if len(first):
                yield pa.RecordBatch.from_arrays([label.take(first), label.take(second), *(t.column(c).combine_chunks().take(first) for c in ("k", "fp", "size"))], names=["a", "b", "k", "fp", "size"])

    kind = members.schema["label"].dataType.simpleString()
    dealt = dealt.select("task", "label", "fp", "size", "k", "n").repartition("task").sortWithinPartitions("task", "label")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, k long, fp binary, size int")


class Lookup:
    """The members of a bucket that are apart from its largest group, in a BK-tree."""

    def __init__(self, near: Near):
        from .simhash import BKTree

        self.near, self.tree, self.at = near, BKTree(), {}

    def add(self, member: tuple) -> None:
        if member[0] not in self.at:
            self.tree.add(member[0])
            self.at[member[0]] = []
        self.at[member[0]].append(member)

    def find(self, member: tuple, major: bool, k: int):
        """Members of other groups that may be similar, each pair in the first bucket that both are in, once."""
        v, n, row, root, bands = member[:5]
        for m in self.tree.within(v, self.near.search(n)) if self.at else ():
            for other in self.at[m]:
                if other[3] != root and (major or row > other[2]) and self.near.may(v, m, n, other[1]) and k == next(x for x, y in zip(bands, other[4]) if x == y):
                    yield other


def _apart(members: DataFrame, roots: DataFrame, texts: DataFrame, size: int, max_part: int, least: float) -> DataFrame | None:
    """``a, b``: labels of similar members of one bucket that ``roots`` (``node, root``) leaves apart; None if there can't be any."""
    placed = members.join(roots.withColumnRenamed("node", "label").hint("merge"), "label", "left").withColumn("root", F.coalesce("root", "label").row)
    placed = materialize(placed, "similar_placed")
    own = placed.groupBy("k", "root").agg(F.count(F.lit(1)).alias("c"))
    buckets = own.groupBy("k").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("major"), F.sum("c").alias("total")).filter("roots > 1")
    buckets = materialize(buckets.select("k", F.col("major.root").alias("major"), (F.col("total") - F.col("major.c")).alias("apart"), "total"), "similar_buckets")
    total = buckets.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    rows = join_hot(placed.drop("n"), buckets.select("k", "major", "apart", F.col("total").alias("of"), "total"), ["k"], "total", total, "label").filter("major IS NOT NULL")
    trees, chunks = F.ceil(F.col("apart") / max_part).cast("int"), F.ceil(F.col("of") / (8 * max_part)).cast("int")
    hashed, every = F.xxhash64("label"), lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["k", "label", "fp", "size", "bands", "root", "major"]
    in_tree = rows.filter("root <> major").select(*cols, F.lit(0).alias("side"), F.pmod(hashed, trees).cast("int").alias("p"), every(chunks).alias("q"))
    asking = rows.select(*cols, F.lit(1).alias("side"), every(trees).alias("p"), F.pmod(hashed, chunks).cast("int").alias("q"))
    dealt = in_tree.union(asking).select(F.xxhash64("k", "p", "q").alias("task"), "side", F.col("label.row").alias("row"), "label", "fp", "size", "root", (F.col("root") == F.col("major")).alias("major"), "k", "bands")
    near = Near(least)

    def read(batch):
        """(side, major, bucket, task) and the member of each row."""
        cols = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("task", "side", "major", "k", "fp", "size", "row", "root", "bands"))
        return [(task, side, major, k, (int.from_bytes(fp, "big"), n, row, root, bands)) for task, side, major, k, fp, n, row, root, bands in zip(*cols)]

    def asked(batches):
        """Rows that are part of a pair to be compared: only their texts are fetched."""
        import pyarrow as pa

        for t in sorted_runs(batches, "task"):
            lookup, marked = Lookup(near), set()
            for i, (_, side, major, k, member) in enumerate(read(t)):
                if side:
                    found = [other[5] for other in lookup.find(member, major, k)]
                    marked.update(found and [i, *found])
                else:
                    lookup.add((*member, i))
            if marked:
                yield from t.take(pa.array(sorted(marked))).combine_chunks().to_batches()

    def compared(batches):
        import pyarrow as pa

        last, lookup, parent = None, None, {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        for batch in batches:
            links = []
            labels, texts = batch.column(batch.schema.get_field_index("label")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist()
            for label, text, (task, side, major, k, member) in zip(labels, texts, read(batch)):
                if task != last:
                    last, lookup, parent = task, Lookup(near), {}
                own = shingles(text, size)
                if not side:
                    lookup.add((*member, own, label))
                    continue
                for other in lookup.find(member, major, k):
                    x, y = find(member[3]), find(other[3])
                    if x != y and jaccard(own, other[5]) >= least:
                        parent[x] = y
                        links.append((other[6], label))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in links], label_type) for i in range(2)], names=["a", "b"])

    from pyspark.sql.pandas.types import to_arrow_type

    label_type, kind = to_arrow_type(members.schema["label"].dataType), members.schema["label"].dataType.simpleString()
    order = ["task", "side", "row"]
    wanted = materialize(dealt.repartition("task").sortWithinPartitions(*order).mapInArrow(asked, dealt.schema), "similar_asked")
    if wanted.isEmpty():
        return None
    together = wanted.join(texts.hint("merge"), "row").repartition("task").sortWithinPartitions(*order)
    return materialize(together.mapInArrow(compared, f"a {kind}, b {kind}"), "similar_links")


def _checked(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose texts (``row, text``) are similar. Each text goes to its leaders' tasks once; a leader of many has several."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = join_hot(pairs, per.select("a", "n", F.col("n").alias("of")), ["a"], "n", pairs.count(), "b")
    dealt = dealt.select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("of") / CHECKS))).alias("task"))
    dealt = materialize(dealt, "similar_dealt")
    heads = dealt.select("a", F.lit(None).cast(dealt.schema["b"].dataType).alias("b"), "task", F.col("a.row").alias("row")).distinct()
    wanted = dealt.select("a", "b", "task", F.col("b.row").alias("row")).union(heads)
    rows = wanted.join(texts.hint("merge"), "row").select("task", "a", "b", "text")

    def run(batches):
        import pyarrow as pa

        head, own = None, None
        for batch in batches:
            near = []
            for at, (row, b, text) in enumerate(zip(batch.column(1).field("row").to_pylist(), batch.column(2).is_null().to_pylist(), batch.column(3).to_pylist())):
                found = shingles(text, size)
                if b:
                    head, own = row, found
                elif row == head and jaccard(own, found) >= least:
                    near.append(at)
            yield batch.select(["a", "b"]).take(pa.array(near, pa.int64()))

    kind = pairs.schema["a"].dataType.simpleString()
    found = rows.repartition("task").sortWithinPartitions("task", "a", F.col("b").asc_nulls_first()).mapInArrow(run, f"a {kind}, b {kind}")
    return materialize(found, "similar_links")


def links(nodes: DataFrame, rows: DataFrame, size: int = SIZE, least: float = LEAST, max_part: int = MAX_PART) -> DataFrame:
    """``node, root``: components over the links between similar nodes; those without a link are left out."""
    bands = nodes.select("label", F.explode("bands").alias("k"))
    shared = bands.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = nodes.count() * BANDS
    shared = materialize(join_hot(bands, shared.select("k", "n", F.col("n").alias("of")), ["k"], "n", total, "label").filter("of IS NOT NULL").withColumnRenamed("of", "n"), "similar_shared")
    members = materialize(shared.join(nodes.select("label", "fp", "size", "bands").hint("merge"), "label"), "similar_members")
    discard(shared)
    wanted = members.select(F.col("label.row").alias("row")).distinct()
    texts = materialize(rows.select("row", "text").join(wanted.hint("merge"), "row", "left_semi"), "similar_texts")

    found, level, before = [], members, math.inf
    while True:
        led = materialize(_led(level, max_part, least), "similar_leaders")
        found.append(led.filter("b IS NOT NULL").select("a", "b"))
        top = led.filter("b IS NULL").select(F.col("a").alias("label"), "k", "fp", "size")
        crowded = top.count()
        if not crowded or 2 * crowded > before:
            break
        # Few leaders are left of each crowded bucket; its count goes with it.
        n = top.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        level = materialize(join_hot(top, n.select("k", "n", F.col("n").alias("of")), ["k"], "n", crowded, "label").withColumnRenamed("of", "n"), "similar_level")
        before = crowded
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs.distinct(), "similar_pairs")
    roots = materialize(connected_components(_checked(pairs, texts, size, least)), "similar_roots")
    more = _apart(members, roots, texts, size, max_part, least)
    discard(texts)
    if more is None:
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, row_col: str | None = None, max_part: int = MAX_PART) -> DataFrame:
    """``row, doc_id, component_id, first`` for each row.

    ``component_id``: the least doc_id among all documents that steps of a
    shingle similarity of ``least`` or more reach. ``first`` is true for one row
    of each group: that of the least doc_id, of repeated rows one. ``row``: the
    long in ``row_col`` that tells the rows apart, or a number given here.
    Null and empty texts are alike. Rows with a null doc_id link too, and come
    after all others; a group of such rows only has a null component. Extra
    columns are ignored. An empty table gives an empty result.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialize(_signatures(rows, size), "similar_signatures")
    # A node's label starts with its first row, so that a component's least label names the first of all its rows.
    label = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    nodes = signed.groupBy("s1", "s2").agg(label.alias("label"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "similar_nodes")
    roots = links(nodes, rows, size, least, max_part).withColumnRenamed("node", "label")
    named = nodes.select("s1", "s2", "n", "label").join(roots.hint("merge"), "label", "left").select("s1", "s2", "n", F.coalesce("root", "label").alias("root"))
    total = signed.count()
    found = join_hot(signed.select("row", "doc_id", "s1", "s2"), named, ["s1", "s2"], "n", total, "row")
    return found.select("row", "doc_id", F.col("root.id").alias("component_id"), (F.col("root.row") == F.col("row")).alias("first"))
