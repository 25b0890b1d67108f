import random

import numpy as np
import pytest

from ledgerflow.llm import embeddings, simhash
from ledgerflow.llm.components import connected_components


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (7, None), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(302, [p for p in pairs if None not in p])
    assert all(want[k] == v for k, v in got.items())
    assert {x for a, b in pairs if b is not None and a != b for x in (a, b)} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7]:
        assert sorted(tree.within(q, 4)) == sorted(v for v in values if (v ^ q).bit_count() <= 4)


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n\t") == 0
    assert simhash.fingerprint(b"One two\x0bTHREE") == xxhash.xxh64_intdigest(b"one two three", 42)
    a, b = (xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d e"))
    assert simhash.fingerprint(b"a b c d e") == a & b  # set in over half of two: in both


@pytest.mark.parametrize("max_part", [3, 1024])
def test_near_duplicates_match_brute_force(spark, max_part):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    for t in list(texts):
        for _ in range(6):
            own = t.split()
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    texts += ["", None, "x", texts[0], texts[0]]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, texts[1], "clash", 0), (0, texts[0], "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(docs, max_part=max_part).collect()
    assert len(got) == len(rows)
    fps = [simhash.fingerprint(t.encode() if t else None) for _, t, _, _ in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((-1 if i is None else i, f"{f:016x}", least[r]) for (i, *_), f, r in zip(rows, fps, root))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 2048])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(10, 16))
    vecs = [(b + rng.normal(size=16) * s).astype(np.float32).tolist() for b in base for s in (0, 0, 0.02, 0.05, 0.08, 0.1)]
    labels = [i % 2 for i in range(len(vecs))]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [], vecs[0], vecs[0][:8]]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(zip(vecs + odd, labels + [0] * len(odd)))] + [(500, vecs[0], None), (None, vecs[0], 0), (0, vecs[0], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = embeddings.near_duplicates(df, block=block).collect()
    fine = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (fine[i] and fine[j]) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98

    n = len(rows)
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j and linked(i, j)]
    root, least = components(n, pairs), {}
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    key = lambda x: tuple(-1 if y is None else y for y in x)
    want = sorted(key((rows[i][0], sum(a == i for a, _ in pairs), least[root[i]], rows[i][0] == least[root[i]])) for i in range(n))
    assert sorted(key((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
