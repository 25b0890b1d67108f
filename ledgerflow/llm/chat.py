"""Roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles; a line shows a speaker marker (from its role column, or
from the start of its text) and features of its text. Start, transitions and
features are counted on the lines whose marker names a role; a marker errs with
a fixed small probability. Viterbi recovers the roles of each conversation.

A conversation is worked on in chunks of turns. Those of one chunk, all but
extreme ones, are decoded where they are. For longer ones each chunk first gives
the best scores from each role before it to each role at its end (nine numbers),
the chunks of a conversation are chained over these, and every chunk is then
decoded between its fixed ends. A chunk whose turns repeat so much that it is
crowded is dealt into pieces, which are chained like chunks; no task holds a
whole long conversation's lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, fresh, materialize, sorted_runs, writable

ROLES = ("system", "user", "assistant")
#: What speakers are called, by role (fixed values).
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q", "you"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "agent", "answer", "a"),
}
#: Probability that a marker names another role than the speaker's.
MARKER_ERROR = 0.02
CHUNK = 512
#: A chunk of turns with more lines than so many a turn is crowded.
CROWDED = 4
LENGTHS = 12

_NAMES = "|".join(sorted((n for names in MARKERS.values() for n in names), key=lambda n: (-len(n), n)))
#: A speaker marker at the start of a text: "User:", "### Assistant", "<|system|>", "[user]", "**Human**:".
_MARKER = rf"(?i)^\s*(?:<\|(?:im_start\|>)?\s*({_NAMES})(?:\|>|\s*\n)|(?:###?|\*\*|\[)\s*({_NAMES})\s*(?:\*\*|\])?\s*(?::|\n|$)|({_NAMES})\s*:)\s*"


def _role_of(name: Column) -> Column:
    """Number of the role that a marker names, from 0; -1 for none."""
    out = F.lit(-1)
    for i, role in enumerate(ROLES):
        out = F.when(F.lower(F.trim(name)).isin(*MARKERS[role]), i).otherwise(out)
    return F.coalesce(out, F.lit(-1)).cast("int")


def features(lines: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``lines`` with ``hmm_marker`` (-1 to 2), ``hmm_feature`` (length class and closing question mark) and ``hmm_text`` (without a marker)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inside = F.coalesce(*(F.nullif(F.regexp_extract(text, _MARKER, k), F.lit("")) for k in (1, 2, 3)))
    length = F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(text) + 1)).cast("int"))
    named = _role_of(F.col(role_col))
    return lines.withColumns({
        "hmm_marker": F.when(named >= 0, named).otherwise(_role_of(inside)),
        "hmm_feature": (2 * length + F.when(F.rtrim(text).endswith("?"), 1).otherwise(0)).cast("int"),
        "hmm_text": F.regexp_replace(text, _MARKER, ""),
    })


def fit(starts: dict, steps: dict, seen: dict):
    """Log start (roles), transitions (roles x roles), features (roles x features) and markers (roles x markers, none last) from counts by role numbers."""
    import numpy as np

    k = len(ROLES)
    start, step, feature = np.ones(k), np.ones((k, k)), np.ones((k, 2 * LENGTHS))
    step += 20 * np.array([[0, 1, 0], [0, 0, 1], [0, 1, 0]])  # system, user, assistant, user, ... where nothing was seen
    start += [5, 10, 0]
    for r, n in starts.items():
        start[r] += n
    for (a, b), n in steps.items():
        step[a, b] += n
    for (r, f), n in seen.items():
        feature[r, f] += n
    marker = np.full((k, k + 1), MARKER_ERROR / (k - 1))
    marker[np.arange(k), np.arange(k)] = 1 - MARKER_ERROR
    marker[:, k] = 1.0  # no marker says nothing
    return tuple(np.log(m / m.sum(axis=-1, keepdims=True)) if m is not marker else np.log(m) for m in (start, step, feature, marker))


def scores(model, marker, feature):
    """Log emissions: lines x roles. Text features are weak evidence and count for a tenth."""
    _, _, f, m = model
    return m[:, marker].T + 0.1 * f[:, feature].T


def viterbi(model, emit, entry: int | None = None, exit_: int | None = None) -> list[int]:
    """The best roles of successive lines; ``entry`` is the role before them, if there is one, ``exit_`` fixes the last."""
    import numpy as np

    start, step = model[0], model[1]
    best = emit[0] + (start if entry is None else step[entry])
    back = []
    for e in emit[1:]:
        way = best[:, None] + step
        back.append(way.argmax(axis=0))
        best = way.max(axis=0) + e
    roles = [int(best.argmax()) if exit_ is None else exit_]
    for b in reversed(back):
        roles.append(int(b[roles[-1]]))
    return roles[::-1]


def span_scores(model, emit):
    """Best scores from each role before the lines, or (last row) from the start, to each role of the last line."""
    import numpy as np

    best = np.vstack([model[1], model[0]]) + emit[0]
    for e in emit[1:]:
        best = (best[:, :, None] + model[1][None]).max(axis=1) + e
    return best


def _counts(lines: DataFrame) -> tuple[dict, dict, dict]:
    """Counts for fit(): of first roles, of successive roles and of features. Successors are found by a join on turn + 1, not by a window over a conversation."""
    known = lines.filter("hmm_marker >= 0")
    seen = {(r[0], r[1]): r[2] for r in known.groupBy("hmm_marker", "hmm_feature").count().collect()}  # roles x features
    at = known.groupBy("conv", "turn").agg(F.min("hmm_marker").alias("m"))
    after = at.select("conv", (F.col("turn") - 1).alias("turn"), F.col("m").alias("next"))
    steps = {(r[0], r[1]): r[2] for r in at.join(after, ["conv", "turn"]).groupBy("m", "next").count().collect()}
    first = lines.filter("conv IS NOT NULL").groupBy("conv").agg(F.min(F.struct("turn", "hmm_marker")).alias("f")).select("f.hmm_marker")
    alone = lines.filter("conv IS NULL").select("hmm_marker")
    starts = {r[0]: r[1] for r in first.unionAll(alone).filter("hmm_marker >= 0").groupBy("hmm_marker").count().collect()}
    return starts, steps, seen


def _pieces(lines: DataFrame, crowded: DataFrame) -> DataFrame:
    """``lines`` with ``cell`` and ``part``, which order the pieces of a crowded chunk (zero in others), and ``group``, one key of the piece."""
    cut = F.col("bits").isNotNull()
    first = F.lit(-(1 << 63))  # null turns come first
    placed = lines.join(crowded, ["conv", "chunk"], "left").withColumns({
        "cell": F.when(cut, F.coalesce("turn", first)).otherwise(F.lit(0).cast("long")),
        "part": F.when(cut, F.expr("shiftrightunsigned(place, 64 - bits)")).otherwise(F.lit(0).cast("long")),
    })
    # The conversation's length keeps "1", 23 apart from "12", 3.
    return placed.withColumn("group", F.concat_ws(":", F.length("conv"), "conv", "chunk", "cell", "part")).drop("bits")


def parse(lines: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``lines`` with ``role_found`` and ``rendered``, its canonical turn.

    Lines follow each other by turn, equal or repeated turns by role and a hash
    of the text (null first). Where over CROWDED times ``chunk`` lines share
    ``chunk`` successive turns, lines of an equal turn are first ordered by a
    hash of their place in the input, which parts even equal lines. Null and
    unknown roles are lines without a marker, unless their text starts with
    one, which is taken off. Null text counts as empty. A line with a null
    conversation is a conversation of its own. A null turn comes first. Input
    columns named like the added ones are replaced; an empty table gives an
    empty result.
    """
    import numpy as np

    lines = writable(lines.drop("role_found", "rendered"))
    doc = fresh(lines, "hmm_line")
    rows = lines.select(F.struct(*(F.col(f"`{c}`") for c in lines.columns)).alias(doc), F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("hmm_role"), F.col(text_col).alias("hmm_raw"), F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    rows = features(rows, "hmm_role", "hmm_raw").withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-1)).cast("long"))
    rows = rows.withColumn("hmm_raw", F.xxhash64("hmm_raw"))
    slim = materialize(rows.select("conv", "turn", "chunk", "place", "hmm_marker", "hmm_feature", "hmm_role", "hmm_raw"), "chat_features")
    model = fit(*_counts(slim))
    in_chunk = slim.filter("conv IS NOT NULL").groupBy("conv", "chunk").count().filter(F.col("count") > CROWDED * chunk)
    crowded = materialize(in_chunk.select("conv", "chunk", F.ceil(F.log2(F.col("count") / chunk)).cast("int").alias("bits")), "chat_crowded")
    order = ["group", "turn", "hmm_role", "hmm_raw", "place"]

    def emissions(table):
        return scores(model, table.column("hmm_marker").to_numpy(), table.column("hmm_feature").to_numpy())

    at = ["conv", "chunk", "cell", "part", "group"]

    def spans(batches):
        import pyarrow as pa

        for table in sorted_runs(batches, "group"):
            s = span_scores(model, emissions(table))
            yield pa.RecordBatch.from_arrays([*(table.column(c).slice(0, 1).combine_chunks() for c in at), pa.array([s.ravel().tolist()])], names=[*at, "scores"])

    def chain(key, table):
        """Roles before and at the end of each piece of a conversation (nine numbers a piece)."""
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("chunk", "cell", "part")])
        k = len(ROLES)
        mats = [np.array(s).reshape(k + 1, k) for s in table.column("scores").to_pylist()]
        best, back = mats[0][k], []
        for m in mats[1:]:
            way = best[:, None] + m[:k]
            back.append(way.argmax(axis=0))
            best = way.max(axis=0)
        ends = [int(best.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pa.table([table.column("group"), pa.array([-1, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], names=["group", "entry", "exit"])

    keyed = _pieces(slim.filter("conv IS NOT NULL"), crowded)
    long = keyed.groupBy("conv").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b").select("conv")
    spanned = keyed.join(long, "conv", "left_semi").select(*at, *order[1:], "hmm_marker", "hmm_feature").repartition("group").sortWithinPartitions(*order).mapInArrow(spans, "conv string, chunk long, cell long, part long, group string, scores array<double>")
    bounds = materialize(spanned.groupBy("conv").applyInArrow(chain, "group string, entry int, exit int"), "chat_bounds")

    def found(table, roles):
        import pyarrow as pa

        return pa.table([table.column(doc), table.column("hmm_text"), pa.array([ROLES[r] for r in roles], pa.string())], names=[doc, "hmm_text", "role_found"]).to_batches()

    def decode(batches):
        for table in sorted_runs(batches, "group"):
            entry, exit_ = (table.column(c)[0].as_py() for c in ("entry", "exit"))
            yield from found(table, viterbi(model, emissions(table), None if entry in (None, -1) else entry, exit_))

    def decode_alone(batches):
        for batch in batches:
            yield from found(batch, (model[0] + emissions(batch)).argmax(axis=1))

    kind = extended(rows.select(doc), "hmm_text string, role_found string")
    joined = _pieces(rows.filter("conv IS NOT NULL"), crowded).join(bounds, "group", "left")
    together = joined.select(doc, "hmm_text", *order, "hmm_marker", "hmm_feature", "entry", "exit").repartition("group").sortWithinPartitions(*order).mapInArrow(decode, kind)
    alone = rows.filter("conv IS NULL").select(doc, "hmm_text", "hmm_marker", "hmm_feature").mapInArrow(decode_alone, kind)
    rendered = F.concat(F.lit("<|"), "role_found", F.lit("|>\n"), F.trim("hmm_text"), F.lit("\n<|end|>\n"))
    return together.unionAll(alone).select(f"{doc}.*", "role_found", rendered.alias("rendered"))
