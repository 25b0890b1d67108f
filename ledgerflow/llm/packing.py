"""Packing documents into training sequences by cutting-stock column generation.

1.  Documents are tokenized once, in Arrow batches, and cut into full pieces and
    a rest. Each piece has a length class (short lengths as they are, longer ones
    rounded up a little) and its rank within the class among its task's pieces.
    The pieces are written.
2.  Only the histogram over classes comes to the driver: under ``limit`` rows.
    A linear program over patterns (which classes share a sequence) is solved by
    column generation: a knapsack dynamic program prices new patterns.
3.  Patterns are taken a whole number of times; what is left is packed largest
    first. A piece's rank in its class says which use of which pattern it fills.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LIMIT = 2048
#: Widths of length classes, and the lengths that they go up to: short pieces have classes of their own, so that rounding costs under a percent of any.
WIDTHS = ((64, 1), (256, 2), (math.inf, 8))
END_ID = 1
#: Bytes of words and ids that a Python worker keeps at most, with what an entry takes besides; longer words than LONG_WORD aren't kept.
CACHE_BYTES, ENTRY_BYTES, LONG_WORD = 256 << 20, 200, 64
SLICE_WORDS = 200_000
MAX_ROUNDS = 1000
#: The program stops with so small a share of sequences over a lower bound.
GAP = 5e-4

_tokenizers: dict[str, "Tokens"] = {}
#: A word of ASCII and Latin-1 letters, which no normaliser but lower-casing changes, between ASCII signs other than apostrophes.
_SIGNS = r"[!-&(-/:-@\[-`{-~]*"
_WORD = re.compile(f"({_SIGNS})([A-Za-zÀ-ÖØ-öø-ÿ]+)({_SIGNS})")
#: How byte-level BPE writes bytes: printable ones as themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class _Words(dict):
    """Ids by word; a new word is learnt as it is looked up."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        return self.learn(word)


class Tokens:
    """Ids of texts by a tokenizer whose pre-tokenizer parts at white space, so that a word's ids don't depend on others and can be kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.long, self.bytes, self.fast = Tokenizer.from_file(path), _Words(self._learn), {}, 0, False
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A character that all of them have, if there is one, rules most words out at once.
        self.mark = next((c for c in self.added[0] if all(c in a for a in self.added)), "") if self.added else ""
        # Letters can go to the merges at once and signs apart, if this tokenizer lower-cases, parts and shows bytes as _learn takes it to.
        probe = ["word", "\u00fcber\u00df", "\u00e9\u00e0\u00f1\u00ff", "WordS", "\u00dcBER\u00c9", "(word", "w.%%%", "_$A\u00d1o#,!!", "&b;", "[C]", "-d-"]
        self.fast = all(self._parted(_WORD.fullmatch(w)) == self._encoded(w) for w in probe)
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.bytes = 0

    def _encoded(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def _keep(self, word: bytes, ids: bytes) -> None:
        """Long words are kept for the slice only, others with what they take in bytes: a word's ids have four times its bytes at most."""
        if len(word) > LONG_WORD:
            self.long[word] = ids
        else:
            self.words[word] = ids
            self.bytes += ENTRY_BYTES + 5 * len(word)

    def _parted(self, m: re.Match) -> bytes:
        """Ids of signs, letters in lower case and signs, each on its own; keeps those of the parts."""
        head, letters, tail = m.groups()
        low = letters.lower()
        stem = low.encode()
        ids = self.words.get(stem, self.long.get(stem))
        if ids is None:
            shown = low if low.isascii() else "".join([_BYTES[b] for b in stem])
            ids = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(shown)])
            self._keep(stem, ids)
        return (self.words[head.encode()] if head else b"") + ids + (self.words[tail.encode()] if tail else b"") if head or tail else ids

    def _learn(self, raw: bytes) -> bytes:
        """A new word's ids, which are kept."""
        if raw in self.long:
            return self.long[raw]
        word = raw.decode()
        m = _WORD.fullmatch(word) if self.fast else None
        # Words that hold an added token's text in any case stay whole: the tokenizer finds these before it lower-cases.
        if m and self.mark in word and any(a in word.lower() for a in self.added):
            m = None
        ids = self._parted(m) if m else self._encoded(word)
        if raw not in self.words:
            self._keep(raw, ids)
        return ids

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of UTF-8 text. Only ASCII white space parts words here; the tokenizer sees to any other."""
        words, out = text.split(), []
        for i in range(0, len(words), SLICE_WORDS):
            out.append(b"".join(map(self.words.__getitem__, words[i : i + SLICE_WORDS])))
            self.long.clear()
            if self.bytes > CACHE_BYTES:
                self._forget()
        return b"".join(out)


def tokens(path: str) -> Tokens:
    """The tokenizer of ``path``, with what this process has learnt by now."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def length_class(length: int, limit: int) -> int:
    """The length that a piece is taken to have: rounded up to its class's width, to ``limit`` at most."""
    width = next(w for most, w in WIDTHS if length <= most)
    return min(limit, -(-length // width) * width)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``, the ``ids`` if wanted, and ``task, class, rank``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        seen: Counter = Counter()
        task, tok, end = TaskContext.get().partitionId(), tokens(tokenizer), END_ID.to_bytes(4, "little")
        names = ["row", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"]
        for b in batches:
            cols, kept = {n: [] for n in names}, []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = tok.ids(text or b"") + end
                n = len(ids) // 4
                for start in range(0, n, limit):
                    length = min(limit, n - start)
                    part = ids[4 * start : 4 * (start + length)]
                    c = length_class(length, limit)
                    for name, v in zip(names, (row, start, length, zlib.crc32(part), n, c, seen[c])):
                        cols[name].append(v)
                    seen[c] += 1
                    if keep_ids:
                        kept.append(part)
            arrays = [b.column(0).take(pa.array(cols.pop("row"), pa.int64())), *(pa.array(v, pa.int64()) for v in cols.values()), pa.array([task] * len(cols["start"]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())] if keep_ids else arrays, names=["doc_id", *cols, "task", *["ids"] * keep_ids])

    return rows.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, class long, rank long, task long" + ", ids binary" * keep_ids)


def _price(values, sizes, capacity: int):
    """The pattern of most value by dynamic programming over capacities; its value and its count of each size."""
    import numpy as np

    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, c, "right"))  # sizes ascend
        v = best[c - sizes[:n]] + values[:n]
        i = int(v.argmax())
        if v[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = v[i], i
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return best[capacity], counts


def _start(sizes, demand, capacity: int):
    """A first basis: each pattern is filled largest first from what is left and used until one of its classes, its own column, is used up."""
    import numpy as np

    columns, left, alive = np.diag((capacity // sizes).astype(float)), demand.copy(), np.ones(len(sizes), bool)
    while alive.any():
        pattern, room = np.zeros(len(sizes)), capacity
        for i in np.flatnonzero(alive)[::-1]:
            pattern[i] = min(room // sizes[i], int(np.ceil(left[i])))
            room -= int(pattern[i] * sizes[i])
        has = pattern > 0
        ratios = np.where(has, left / np.where(has, pattern, 1), np.inf)
        own = int(ratios.argmin())
        left -= ratios[own] * pattern
        left[own] = 0
        alive &= left > 1e-9
        columns[:, own] = pattern
    return columns


def patterns(histogram: dict[int, int], capacity: int, max_rounds: int = MAX_ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many of each class) and how often each is used, for all pieces of the histogram exactly.

    Column generation by the primal simplex method, to within GAP of the best
    lower bound (of Farley's and the sum of sizes). Stopped early, its basis
    still is a packing of everything.
    """
    import numpy as np

    sizes = np.array(sorted(c for c, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(c)] for c in sizes], dtype=float)
    columns = _start(sizes, demand, capacity)  # a pattern a column
    bound = float(sizes @ demand) / capacity
    inverse = np.linalg.inv(columns)
    x = np.maximum(inverse @ demand, 0)
    for k in range(max_rounds):
        value, new = _price(inverse.sum(axis=0), sizes, capacity)
        bound = max(bound, x.sum() / value)
        if x.sum() <= bound * (1 + GAP):
            break
        d = inverse @ new
        ratios = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        x -= step * d
        x[out] = step
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        columns[:, out] = new
        if k % 100 == 99:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ demand, 0)
    left, used = demand.astype(np.int64), []
    for j in np.argsort(-x, kind="stable"):
        col = columns[:, j].astype(np.int64)
        has = col > 0
        times = min(int(x[j] + 1e-6), int((left[has] // col[has]).min()))
        if times > 0:
            used.append((col, times))
            left -= times * col
    while left.any():  # largest first, each pattern as often as it goes
        col, room = np.zeros_like(left), capacity
        for i in range(len(sizes) - 1, -1, -1):
            col[i] = min(left[i], room // sizes[i])
            room -= col[i] * sizes[i]
        has = col > 0
        times = int((left[has] // col[has]).min())
        used.append((col, times))
        left -= times * col
    return [({int(s): int(n) for s, n in zip(sizes, col) if n}, times) for col, times in used]


def _slots(used: list[tuple[dict[int, int], int]]):
    """For each pattern and class in it: the class, its first rank, pieces a use, first sequence, first slot. Sorted by class, then rank."""
    rows, given, sequence = [], {}, 0
    for pattern, times in used:
        slot = 0
        for c in sorted(pattern, reverse=True):
            rows.append((c, given.get(c, 0), pattern[c], sequence, slot))
            given[c] = given.get(c, 0) + pattern[c] * times
            slot += pattern[c]
        sequence += times
    return sorted(rows)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if wanted, ``ids`` (unsigned 32-bit, little-endian).

    A document's ids end with id 1; each lies in exactly one piece. A sequence
    has at most ``limit`` ids, gapless from offset 0. Null text counts as empty
    and has the closing id alone. Repeated rows are packed each. Null ids stay
    null. Other columns are ignored; an empty table gives an empty result.
    """
    import numpy as np

    cut = materialize(pieces(docs, tokenizer, id_col, text_col, limit, keep_ids), "pieces")
    counted = materialize(cut.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    histogram = {r["class"]: r["n"] for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # a row for each class
    slots = _slots(patterns(histogram, limit))
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    names = [c for c in cut.columns if c not in ("task", "class", "rank")]
    ranked = cut.join(offsets, ["task", "class"]).select(*names, F.shiftleft("class", 48).alias("class_key"), (F.col("rank") + F.col("earlier")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        for b in batches:
            c, r = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("class_key", "rank"))
            own = table[np.searchsorted(keys, c + r, "right") - 1]
            k = r - own[:, 1]
            kept = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own[:, 3] + k // own[:, 2]), pa.array(own[:, 4] + k % own[:, 2])], names=[*names, "sequence_id", "slot"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    placed = ranked.mapInArrow(place, f"{fields}, sequence_id long, slot long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).drop("slot")
