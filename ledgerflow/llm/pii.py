"""Personal data by patterns, made consistent within each document by a skip-chain conditional random field.

Base spans come from four patterns and are observed. The other nodes of a
document's field are number and mail-like spans that no pattern took. Nodes
close to each other share a chain potential. Nodes with one key (their last ten
digits, or their letters and digits), however far apart, share a skip
potential with the group that they make, so that what one of them shows reaches
all of them, and doesn't fade with their number. The shape of a node speaks for its
label by its share of the group, and not at all where a pattern took one of the
group. Loopy message passing (sum-product) runs until messages settle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, writable

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field's potentials are fitted on, at most about so many, taken by the hash of their text.
FIT_DOCS = 20_000
MIN_DIGITS = 7
#: Rounds of messages at most, those that go undamped, and the change at which they have settled.
ROUNDS, UNDAMPED, SETTLED = 100, 10, 1e-4
ACCEPT = 0.9
#: Characters between neighbours of the chain at most; digits of a word that others can join.
NEAR, JOINED = 16, 8
#: Prior of the skip weight (mean) and of all weights (precision), steps of the fit.
SKIP_PRIOR, PRECISION, STEPS = 8.0, 0.05, 300

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only and never given back, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EVIDENCE = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9]+")
_SPACES = frozenset(" \t\n\x0b\f\r")
_PLAIN = re.compile(r"[^0-9A-Za-z]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind; by start, then kind. A match that fails its test is dropped and not tried again."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 3 or p.lstrip("0")[:4] == "" or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _PLAIN.sub("", m[0])) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, end, label, shape, key) of the field's nodes, in order: base spans (``label``: the number, from 1, of the kind) and, with label 0, what else holds digits or an @.

    Chunks between white space are trimmed of marks around; numbers that only blanks part are one node, up to 19 digits.
    """
    nodes = [(s, e, KINDS.index(k) + 1, *_features(text[s:e])) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    i, end, last = 0, 0, 0
    run: list[list[int]] = []  # start, end, digits, digits of the last word
    for m in _EVIDENCE.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in _SPACES:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        s, e = start, end
        while not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] == ")"):
            e -= 1
        while i < len(taken) and taken[i][1] <= s:
            last = max(last, taken[i][1])
            i += 1
        if s >= e or last > s or any(f < e and g > s for f, g in taken[i : i + len(KINDS)]):
            continue
        plain = _PLAIN.sub("", text[s:e])
        n = len(plain) if plain.isdigit() and "@" not in text[s:e] else 0
        if run and 0 < n <= JOINED and 0 < run[-1][3] <= JOINED and run[-1][2] + n <= 19 and text[s] != "+" and not text[run[-1][1] : s].strip(" "):
            run[-1][1:] = [e, run[-1][2] + n, n]
        else:
            run.append([s, e, n, n])
    return sorted(nodes + [(s, e, 0, *_features(text[s:e])) for s, e, _, _ in run])


def _features(piece: str) -> tuple[str, str]:
    """Shape of a span (runs of digits by length; marks as they are; whether Luhn's test holds), and the key that like spans share ("" for none)."""
    plain = _PLAIN.sub("", piece).lower()
    if "@" in piece:
        return "@", plain
    if not plain.isdigit():
        return "mixed", plain
    shape = _RUN.sub(lambda m: f"9{min(len(m[0]), 20)}", piece) if len(piece) <= 40 else "long"
    if 12 <= len(plain) <= 19 and _luhn(plain):
        shape += " Luhn"
    # Numbers are alike in their last ten digits: a country code may be there or not. Addresses are alike as they are.
    return shape, piece if piece.count(".") == 3 else plain[-10:] if len(plain) >= MIN_DIGITS else ""


def edges(nodes: list, first: int = 0) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Chain edges between close neighbours of different keys, and the groups (two nodes or more) of one key."""
    chain = [(first + i, first + i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR and not (nodes[i][4] and nodes[i][4] == nodes[i + 1][4])]
    groups: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        if n[4]:
            groups.setdefault(n[4], []).append(first + i)
    return chain, [g for g in groups.values() if len(g) > 1]


class Potentials:
    """Log potentials of the field; labels are 0 (none) and the kinds from 1. ``skip``: what it is worth that a node has its group's label."""

    def __init__(self, shapes: dict[str, list[float]], chain, skip: float):
        self.shapes, self.chain, self.skip = shapes, chain, skip


def contexts(nodes: list):
    """(shape, share of its group, label before, label after, the others' label in its group, own label) of each node, -1 where there is none; nodes that no pattern took, of a group in which one did, are unknown and left out."""
    chain, groups = edges(nodes)
    before, after = {b: nodes[a][2] for a, b in chain}, {a: nodes[b][2] for a, b in chain}
    group = {i: g for g in groups for i in g}
    for i, n in enumerate(nodes):
        others = [nodes[j][2] for j in group.get(i, ()) if j != i]
        seen = [x for x in others if x]
        if n[2] or not seen:
            share = 0 if seen else len(others) + 1
            yield n[3], share, before.get(i, -1), after.get(i, -1), seen[0] if seen else 0 if others else -1, n[2]


def fit(counts: list[tuple]) -> Potentials:
    """Weights of most pseudo-likelihood, with a Gaussian prior, from ``contexts`` and their counts."""
    import numpy as np

    k = len(KINDS) + 1
    shapes = sorted({c[0] for c in counts})
    at = {s: i for i, s in enumerate(shapes)}
    shape = np.array([at[c[0]] for c in counts], int)
    share, left, right, other, label, n = (np.array([c[j] for c in counts], int) for j in range(1, 7))
    share = np.where(share > 0, 1 / np.maximum(share, 1), 0.0)[:, None]
    unary, chain, skip = np.zeros((len(shapes), k)), np.zeros((k, k)), SKIP_PRIOR
    grads = [np.full_like(unary, 1e-8), np.full_like(chain, 1e-8), 1e-8]
    one = np.eye(k)
    sides = [(x >= 0, x) for x in (left, right)]
    for _ in range(STEPS if len(counts) else 0):
        score = share * unary[shape] + skip * one[other] * (other >= 0)[:, None]
        for has, x in sides:
            score += chain[x] * has[:, None]
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        d = n[:, None] * (one[label] - p / p.sum(axis=1, keepdims=True))
        gu, gc = -PRECISION * unary, -PRECISION * chain
        np.add.at(gu, shape, share * d)
        for has, x in sides:
            np.add.at(gc, x[has], d[has])
        gc = (gc + gc.T) / 2
        gs = ((d * one[other])[other >= 0]).sum() - PRECISION * 100 * (skip - SKIP_PRIOR)
        for j, g in enumerate((gu, gc, gs)):  # steps by the size of past gradients
            grads[j] = grads[j] + g * g
        unary, chain, skip = unary + 0.5 * gu / np.sqrt(grads[0]), chain + 0.5 * gc / np.sqrt(grads[1]), skip + 0.5 * gs / np.sqrt(grads[2])
    return Potentials({s: u.tolist() for s, u in zip(shapes, unary)}, chain.tolist(), float(max(skip, SKIP_PRIOR / 2)))


def infer(nodes: list, chain: list, groups: list, p: Potentials, rounds: int = ROUNDS):
    """Marginals (nodes x labels) by loopy sum-product; nodes with a label are observed. Each group is a variable of its own that its members are tied to."""
    import numpy as np

    k = len(KINDS) + 1
    own = np.zeros((len(nodes) + len(groups), k))
    share = np.ones(len(nodes))
    for g in groups:
        share[g] = 0 if any(nodes[i][2] for i in g) else 1 / len(g)
    for i, n in enumerate(nodes):
        if n[2]:
            own[i] = -1e6
            own[i, n[2]] = 0.0
        elif n[3] in p.shapes:
            own[i] = share[i] * np.array(p.shapes[n[3]])
        else:
            own[i, 0] = share[i]
    pairs = chain + [(i, len(nodes) + j) for j, g in enumerate(groups) for i in g]
    if pairs:
        src = np.array([a for a, _ in pairs] + [b for _, b in pairs])
        dst = np.array([b for _, b in pairs] + [a for a, _ in pairs])
        which = np.array([0] * len(chain) + [1] * (len(pairs) - len(chain)))
        pot = np.array([p.chain, (p.skip * np.eye(k)).tolist()])[np.concatenate([which, which])]  # the tables are symmetric
        back = np.concatenate([np.arange(len(pairs), 2 * len(pairs)), np.arange(len(pairs))])
        msg = np.zeros((len(src), k))
        for r in range(rounds):
            total = own.copy()
            np.add.at(total, dst, msg)
            new = np.logaddexp.reduce(pot + (total[src] - msg[back])[:, :, None], axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = new if r < UNDAMPED else 0.5 * msg + 0.5 * new
            if change < SETTLED:
                break
        np.add.at(own, dst, msg)
    own = own[: len(nodes)]
    own -= own.max(axis=1, keepdims=True)
    prob = np.exp(own)
    return prob / prob.sum(axis=1, keepdims=True)


def fits(piece: str, kind: str) -> bool:
    """Whether a span can be of a kind at all: a phone has 7 to 15 digits, a card 12 to 19, a mail an @, an address three dots."""
    digits = sum(c.isdigit() for c in piece)
    return {"email": "@" in piece, "ip": piece.count(".") == 3, "card": 12 <= digits <= 19, "phone": MIN_DIGITS <= digits <= 15}[kind]


def _counted(docs: DataFrame, text_col: str, fit_docs: int) -> list:
    """Counts for fit(), from about ``fit_docs`` documents at most; its rows are as many as there are shapes and labels around in these."""
    n = docs.count()
    few = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    if n > fit_docs:
        few = few.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * fit_docs / n))

    def run(batches):
        import pyarrow as pa

        c: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                c.update(contexts(candidates(text, base_spans(text))))
        rows = [(*key, n) for key, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 6))], names=names)

    names = ["shape", "share", "before", "after", "others", "label", "n"]
    counted = few.mapInArrow(run, "shape string, share long, before long, after long, others long, label long, n long")
    return sorted(tuple(r) for r in counted.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect())


def find(docs: DataFrame, text_col: str = "text", redact: bool = False, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with ``pii_spans``, an array of (kind, start, end, base) in order of start, then kind.

    Places are code points, ends exclusive. ``base`` tells the patterns' spans
    from those that the field adds. With ``redact`` the text has ``[EMAIL]`` and
    so on in their place (overlapping spans become one, named by the first).
    Null text has no spans and stays null. Repeated rows each get their spans.
    An input column ``pii_spans`` is replaced; an empty table gives an empty result.
    """
    p = fit(_counted(docs, text_col, fit_docs))
    docs = writable(docs.drop("pii_spans"))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    ddl = "array<struct<kind: string, start: long, end: long, base: boolean>>"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = [base_spans(t) if t else [] for t in texts]
            nodes, chain, groups, of = [], [], [], []
            for i, (t, base) in enumerate(zip(texts, spans)):
                if t and ("@" in t or _DIGIT.search(t)):
                    own = candidates(t, base)
                    if any(not n[2] for n in own):
                        c, g = edges(own, len(nodes))
                        chain += c
                        groups += g
                        nodes += own
                        of += [i] * len(own)
            added = defaultdict(list)
            if nodes:
                for i, n, q in zip(of, nodes, infer(nodes, chain, groups, p)):
                    k = int(q.argmax())
                    if not n[2] and k and q[k] >= ACCEPT and fits(texts[i][n[0] : n[1]], KINDS[k - 1]):
                        added[i].append((n[0], KINDS[k - 1], n[1]))
            rows, new = [], []
            for i, t in enumerate(texts):
                all_ = sorted([(s, KINDS.index(k), e, True) for s, k, e in spans[i]] + [(s, KINDS.index(k), e, False) for s, k, e in added.get(i, ())])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in all_])
                if redact:
                    new.append(_redacted(t, all_))
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*batch.schema.names, "pii_spans"])

    return mapped(docs, run, f"pii_spans {ddl}")


def _redacted(text: str | None, spans: list) -> str | None:
    if not spans:
        return text
    out, last = [], 0
    for start, kind, end, _ in spans:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])
