import random

import corpus_pipeline

from ledgerflow.llm import similar


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """The least id of each row's component, by all pairs."""
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted((-1 if i is None else i, least[r]) for (i, _), r in zip(rows, root))


def changed(rng, text, n):
    own = text.split()
    for i in rng.sample(range(len(own)), n):
        own[i] = f"changed{rng.randrange(10**9)}"
    return " ".join(own)


def test_similar_match_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(10)]
    for t in texts[:10]:
        for n in (1, 3, 5, 6, 7, 9, 15, 40):  # similarities from 0.97 to under 0.4
            texts.append(changed(rng, t, n))
    texts += [changed(rng, texts[0], 6) for _ in range(60)]  # a group whose members are similar to their source only
    texts += ["", None, "x", "X ", texts[0].upper(), texts[1] + "\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (0, texts[0])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == plain_components(rows)
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_stage_drops_copies_with_a_few_changed_words(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=300)) for _ in range(20)]
    texts += [changed(rng, t, 5) for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(20))
