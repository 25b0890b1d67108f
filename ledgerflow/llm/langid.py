"""Language by prediction by partial matching: the language whose byte model gives the text the shortest code.

Each language has a tree of byte contexts of up to ORDER bytes. A byte's code
length is -log2 of its probability in the longest known context, with an escape
to the next shorter one where it wasn't seen (escape method C, no exclusions)
and 1/256 at the end. The counts are frozen after training, so a byte's code
length depends on it and the ORDER bytes before alone. For every context and
byte seen by any language all languages' lengths are therefore worked out once,
and a text is scored by looking up its n-grams, in whole arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, writable

ORDER = 3
#: Bytes of text that a language's tree is trained on, at most (by whole documents, so a last one may go over).
TRAIN_BYTES = 2_000_000
#: Documents that are looked at to fill these, at most, for each language.
TRAIN_DOCS = 2_000
#: Bytes of the frozen tables at most; with so many languages that they would have more, contexts are shortened.
MODEL_BYTES = 256 << 20
#: The score is worked out as if a text had so many bytes at most: successive bytes aren't independent evidence.
SCORE_BYTES = 40
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _grams(data: bytes, order: int):
    """Codes of all n-grams of ``order + 1`` bytes, the text set after ``order`` zero bytes."""
    import numpy as np

    b = np.frombuffer(b"\0" * order + data, np.uint8).astype(np.uint64)
    code = b[order:].copy()
    for k in range(1, order + 1):
        code |= b[order - k : len(b) - k] << np.uint64(8 * k)
    return code


class Model:
    """``langs``, and for each order the sorted codes of its n-grams with all languages' code lengths, and of its contexts with their escapes."""

    def __init__(self, langs, grams, lengths, contexts, escapes):
        self.langs, self.grams, self.lengths, self.contexts, self.escapes = langs, grams, lengths, contexts, escapes

    def code_lengths(self, codes, order: int | None = None):
        """Bits of each n-gram's last byte after the others: n-grams x languages."""
        import numpy as np

        order = len(self.grams) - 1 if order is None else order
        if order < 0:
            return np.full((len(codes), len(self.langs)), 8.0, np.float32)
        table = self.grams[order]
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        out = self.lengths[order][at]
        missing = np.flatnonzero(table[at] != codes)
        if len(missing):
            unseen = codes[missing]
            ctx = unseen >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[order], ctx), len(self.contexts[order]) - 1)
            escape = np.where((self.contexts[order][at] == ctx)[:, None], self.escapes[order][at], np.float32(0))
            shorter = unseen & np.uint64((1 << 8 * order) - 1) if order else unseen
            out[missing] = escape + self.code_lengths(shorter, order - 1)
        return out

    def score(self, text: str | None) -> tuple[str, float]:
        """The language and its probability among all, each language as likely before."""
        import numpy as np

        if not text or not _LETTER.search(text) or not self.langs:
            return UNDETERMINED, 0.0
        data, bits, tail = text.encode(), np.zeros(len(self.langs)), b""
        for i in range(0, len(data), 1 << 20):  # whole text, a piece at a time
            piece = data[i : i + (1 << 20)]
            order = len(self.grams) - 1
            codes = _grams(tail + piece, order)[len(tail) :]
            bits += self.code_lengths(codes).sum(axis=0, dtype=np.float64)
            tail = (tail + piece)[-order:] if order else b""
        best = int(bits.argmin())
        evidence = (bits[best] - bits) * min(1.0, SCORE_BYTES / len(data))
        return self.langs[best], float(1 / np.exp2(np.maximum(evidence, -1000)).sum())


def train(texts: dict[str, list[str]], order: int = ORDER, model_bytes: int = MODEL_BYTES) -> Model:
    """The frozen model of each language's texts; of no text a model that knows no language."""
    import numpy as np

    langs = sorted(lang for lang, own in texts.items() if any(own))
    if not langs:
        return Model([], [], [], [], [])
    counts = []  # for each order and language: codes and their counts
    for n in range(order + 1):
        own = []
        for lang in langs:
            codes = [_grams(t.encode(), order) & np.uint64((1 << 8 * (n + 1)) - 1) for t in texts[lang]]
            own.append(np.unique(np.concatenate(codes), return_counts=True))
        counts.append(own)
    grams = [np.unique(np.concatenate([c for c, _ in own])) for own in counts]
    while order > 1 and sum(map(len, grams)) * 8 * len(langs) > model_bytes:  # two tables of 4 bytes a language
        order -= 1
        grams, counts = grams[:-1], counts[:-1]
    contexts = [np.unique(g >> np.uint64(8)) for g in grams]
    lengths, escapes = [], []
    for n in range(order + 1):
        bits = np.zeros((len(grams[n]), len(langs)), np.float32)
        escape = np.zeros((len(contexts[n]), len(langs)), np.float32)
        parent = np.searchsorted(contexts[n], grams[n] >> np.uint64(8))
        shorter = np.full(bits.shape, 8.0, np.float32) if n == 0 else lengths[n - 1][np.searchsorted(grams[n - 1], grams[n] & np.uint64((1 << 8 * n) - 1))]
        for k, (codes, c) in enumerate(counts[n]):
            count = np.zeros(len(grams[n]))
            count[np.searchsorted(grams[n], codes)] = c
            total = np.bincount(parent, count, len(contexts[n]))
            kinds = np.bincount(parent, count > 0, len(contexts[n]))
            known = total > 0
            escape[known, k] = -np.log2(kinds[known] / (total + kinds)[known])
            all_ = (total + kinds)[parent]
            bits[:, k] = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum(all_, 1)), escape[parent, k] + shorter[:, k])
        lengths.append(bits)
        escapes.append(escape)
    return Model(langs, grams, lengths, contexts, escapes)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> dict[str, list[str]]:
    """Texts by language of documents that aren't held out: at most about ``train_docs`` a language by the hash of their ids, and of these so many as have ``train_bytes``. Texts of more bytes than that never train."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n)))), F.col("l"))
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 20)) / (1 << 20)
    few = known.filter((draw < share) & (F.octet_length("t") <= train_bytes))
    # In order of the draw, documents are taken until they have the bytes: each language's last draw is all that goes into the second plan.
    last, left = {}, dict.fromkeys(sizes, train_bytes)
    for r in sorted(few.select(draw.alias("d"), "l", F.octet_length("t").alias("n")).collect()):
        if left[r["l"]] > 0:
            left[r["l"]] -= r["n"]
            last[r["l"]] = r["d"]
    rows = few.filter(draw <= F.element_at(F.create_map(*(F.lit(x) for pair in last.items() for x in pair)), F.col("l"))).collect() if last else []
    out: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in rows:
        out[r["l"]].append(r["t"])
    return {lang: sorted(t) for lang, t in out.items() if t}


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1): the language of each whole text.

    ``und`` with score 0 for null, empty and letterless texts, and if nothing was
    learned. Repeated rows get the same prediction each; of equally short codes
    the first language by name wins. Input columns named like the added ones are
    replaced; an empty table gives an empty result. The model has MODEL_BYTES at most,
    whatever the size of the corpus, and is sent to the executors.
    """
    spark = docs.sparkSession
    docs = writable(docs.drop("lang_pred", "score"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for b in batches:
            found = [m.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return mapped(docs, run, "lang_pred string, score double")
