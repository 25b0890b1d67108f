import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import plain_components

from ledgerflow.llm import chat, mixing, packing, pii, queries, sharding, urls


def test_targets_match_resharing(spark):
    sizes = {"a": 10, "b": 400, "c": 30, None: 7, "d": 0, "é": 200, "Z": 1000}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values())
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3.0 * sizes[s] for s in over}
    want = fixed | share
    assert all(abs(got[s] - want[s]) < 1e-6 for s in names)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "q", None), (3, None, "y"), (4, "", "x")], "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "void": F.lit(None), "a.b": F.lit(1)})
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and all(0 <= r.copies <= 3 for r in got) and sorted(r["size"] for r in got) == [0, 0, 1, 3, 3]
    assert len({r.copies for r in got if r.doc.doc_id == 1}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


ODD = [(1, None), (2, "abc"), (3, "http://"), (4, "http://NET"), (5, "http://x.net/"), (6, "http://example.net/en/x?y#z"), (7, "x://a.org/fr/://b"), (8, "http://a.org?fr/"), (9, "http://b.example.com/de/\nq"), (10, "http://notexample.com/de/"), (12, "http://u@h.net:80/x"), (5, "http://x.net/")]


@pytest.mark.parametrize("most", [1000, 0])
def test_url_rules(spark, most):
    pages = spark.createDataFrame([(*x, "r") for x in ODD], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("net", "/", "block"), ("org", None, "allow")], "host string, path string, action string")

    def plain(url):
        rest = (url or "").partition("://")
        end = min((rest[2].find(c) for c in "/?#" if c in rest[2]), default=len(rest[2]))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[2][:end])
        tail = rest[2][end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(h + p, a) for h, p, a in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    got = urls.judge(pages, rules, max_rules=most).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, *(x or "" for x in plain(u))) for i, u in ODD)
    assert urls.judge(pages.limit(0), rules, max_rules=most).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), max_rules=most).collect()} == {"allow"}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda k, *a: len(k))
    urls.DigestArray.write([("ab", True), ("cd", False), ("xyz", True)], str(tmp_path / "f"))
    array = urls.DigestArray(str(tmp_path / "f"))
    at = array.find([b"cd", b"ab", b"zz", b"q", b"xyz"])
    assert [int(x >= 0) for x in at] == [1, 1, 0, 0, 1] and [bool(array.allow[x]) for x in at[:2]] == [False, True]


def test_shards_keep_to_the_limit(spark):
    x = spark.range(300).selectExpr("id % 3 AS doc_id", "repeat('x', 50) AS text").union(spark.createDataFrame([(99, "y" * 5000), (None, "z"), (100, None)], "a long, b string")).union(spark.range(200).selectExpr("id + 1000", "repeat('z', int(id))"))
    got = sharding.shard(x, limit=1000, salts=4).select("doc.doc_id", "shard_id", "depth", "bytes").toPandas()
    assert len(got) == 503
    size = got.groupby("shard_id")["bytes"].agg(["sum", "count"])
    assert ((size["sum"] <= 1000) | (size["count"] == 1)).all()
    whole = size[~size.index.str.contains("/")]
    for s in whole.index:  # no bucket was split that fitted
        if s:
            assert whole[whole.index.str.startswith(s[:-1])]["sum"].sum() > 1000
    assert sharding.shard(x.limit(0)).count() == 0


def test_shards_need_no_broadcast_of_their_directory(spark):
    """With Spark's own threshold the prefixes (120,000 here, 80 MiB) were broadcast, since their files are small."""
    x = spark.range(30000).selectExpr("id AS doc_id", "repeat('x', int(IF(id % 10 = 0, 900, 20 + id % 50))) AS text")
    hot = spark.range(6000).selectExpr("IF(id % 2 = 0, -1L, NULL) AS doc_id", "IF(id % 2 = 0, 'four', NULL) AS text")
    setting = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2m")
    try:
        got = sharding.shard(x.union(hot), limit=1000).select("doc.doc_id", "shard_id", "depth", sharding.key_hash(F.col("doc.doc_id")).alias("h"), "bytes").toPandas()
    finally:
        spark.conf.set(setting, before)
    assert len(got) == 36000 and got[got.doc_id == -1].shard_id.str.contains("/").all() and got[got.doc_id.isna()].shard_id.nunique() == 1
    small = got[got.doc_id != -1]
    want = np.full(len(small), -1)
    for d in range(sharding.BITS + 1):
        want[(want < 0) & (small.bytes.groupby(small.h.to_numpy() >> (sharding.BITS - d)).transform("sum") <= 1000)] = d
    assert (small.depth == want).all()
    assert list(small.shard_id) == [format(h >> (sharding.BITS - d), f"0{d}b") for h, d in zip(small.h, want)]


def test_roles_are_recovered(spark):
    lines = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = lines.withColumn("marker", F.when(F.col("turn") % 4 != 2, F.col("role")))
    more = spark.createDataFrame([(9999, 0, None, "### System: be", None), (9999, 1, "foo", "Human: hi?", None), (9999, 2, None, "bot: yo", None), (9999, None, None, None, None), (None, 0, None, "x", None)], hidden.schema)
    long = spark.range(3000).selectExpr("7777L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "'x' AS text").withColumn("marker", F.when(F.col("turn") % 5 != 2, F.col("role")))
    every = hidden.unionByName(more).unionByName(long).withColumns({"rendered": F.lit(1), "void": F.lit(None), "a.b": F.lit(1)})
    key = ["conv_id", "turn", "role", "text"]
    got = {c: sorted(map(repr, chat.parse(every, role_col="marker", chunk=c).select(*key, "role_found", F.col("rendered").alias("out")).collect())) for c in (7, 512)}
    assert got[7] == got[512] and len(got[7]) == every.count()
    known = chat.parse(every, role_col="marker").filter("role IS NOT NULL").collect()
    assert sum(r.role == r.role_found for r in known) / len(known) > 0.98
    shown = {r.turn: (r.role_found, r.rendered) for r in chat.parse(more, role_col="marker").filter("conv_id = 9999 AND turn IS NOT NULL").collect()}
    assert [shown[i][0] for i in range(3)] == ["system", "user", "assistant"] and shown[1][1] == "<|user|>\nhi?\n<|end|>\n"
    assert chat.parse(every.limit(0)).count() == 0


def path_score(model, emit, roles):
    return model[0][roles[0]] + sum(model[1][a, b] for a, b in zip(roles, roles[1:])) + sum(e[r] for e, r in zip(emit, roles))


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_viterbi_finds_the_best_of_all_roles(n):
    rng = np.random.default_rng(n)
    model = chat.fit({1: 3}, {(1, 2): 9, (2, 1): 7, (0, 1): 2}, {(1, 4): 5, (2, 7): 8})
    for _ in range(20):
        emit = chat.scores(model, rng.integers(-1, 3, n), rng.integers(0, 2 * chat.LENGTHS, n))
        best = max(path_score(model, emit, r) for r in itertools.product(range(3), repeat=n))
        assert path_score(model, emit, chat.viterbi(model, emit)) == pytest.approx(best)  # ties may fall either way


def test_crowded_and_null_conversations(spark, monkeypatch):
    """Repeated lines and turns are dealt over pieces, lines without a conversation stand alone."""
    rows = [("c", 0, "user", "x")] * 300 + [("c", None, None, "y")] * 200 + [("c", 1, "assistant", f"t{i:02}") for i in range(100)] + [(None, i % 3, "bot", "z") for i in range(400)]
    lines = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(5)
    runs, models = [], []
    monkeypatch.setattr(chat, "fit", lambda *a, own=chat.fit: models.append(own(*a)) or models[-1])
    monkeypatch.setattr(chat, "_pieces", lambda a, b, own=chat._pieces: runs.append(own(a, b)) or runs[-1])
    got = chat.parse(lines, chunk=8).toPandas()
    assert Counter(map(tuple, got[["conv_id", "turn", "role", "text"]].fillna("-").values)) == Counter(tuple("-" if v is None else v for v in r) for r in rows)
    sizes = [r["count"] for r in runs[0].groupBy("group").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 40
    alone = got[got.conv_id.isna()]
    assert set(alone.role_found) == {"assistant"} and len(alone) == 400
    # Lines of a turn emit alike, so their order doesn't matter: as many of each role as in one pass over all lines.
    shown = chat.features(lines.filter("conv_id IS NOT NULL").orderBy("turn")).select("turn", "hmm_marker", "hmm_feature").toPandas()
    plain = chat.viterbi(models[0], chat.scores(models[0], shown.hmm_marker.values, shown.hmm_feature.values))
    named = got[got.conv_id.notna()]
    assert Counter(zip(shown.turn.fillna(-1), (chat.ROLES[r] for r in plain))) == Counter(zip(named.turn.fillna(-1), named.role_found))
    # The same roles with one piece and with many.
    few = spark.createDataFrame([("d", i, None if i % 3 else ["user", "assistant"][i % 2], "w" * (i % 9)) for i in range(100)], "conv_id string, turn int, role string, text string")
    one, many = (sorted(map(repr, chat.parse(few, chunk=c).collect())) for c in (512, 3))
    assert one == many


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, small)
    kept = {r.doc_id for r in queries.op9_quality(spark, small).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    unique = stages["simhash near-dedup"](spark, good, small)
    left = sorted(r.doc_id for r in unique.collect())
    rows = [(i, before[i].text) for i in sorted(kept)]
    assert left == sorted({least for _, least in plain_components(rows)})  # five-word sets, similarity of 0.8, all pairs
    clean = stages["personal data"](spark, unique, small)
    for r in clean.collect():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
    mixed = stages["mixing"](spark, clean, small)
    assert mixed.columns == docs.columns
    rate = {r.doc.doc_id: r.copies for r in mixing.mix(clean).collect()}
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {i: c for i, c in rate.items() if c}
    packed = stages["packing"](spark, mixed, small)
    assert packed.filter("start = 0").count() == mixed.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == set(n)
    repeated = stages["simhash near-dedup"](spark, docs.union(docs), small).collect()
    assert len(repeated) == len({r.doc_id for r in repeated})
    odd = spark.createDataFrame([(None, "w " * 60, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, small).count() >= 0 and stage(spark, odd.limit(0), small).count() == 0


def test_tokenizer_path_is_a_parameter():
    assert packing.tokens(queries.tokenizer_path()).fast


def test_short_documents_are_packed_with_little_padding():
    rng = random.Random(6)
    for lengths in ([1] * 100_000, [10] * 100_000, [rng.choice((1, 10, 300, 2048)) for _ in range(50_000)], [rng.randint(1, 2048) for _ in range(50_000)]):
        histogram = Counter(packing.length_class(n, 2048) for n in lengths)
        used = packing.patterns(histogram, 2048)
        filled = Counter()
        for pattern, times in used:
            assert sum(c * n for c, n in pattern.items()) <= 2048
            filled.update({c: n * times for c, n in pattern.items()})
        assert filled == histogram
        assert sum(lengths) >= 0.98 * 2048 * sum(times for _, times in used)


def test_words_are_kept_by_bytes(monkeypatch):
    path = queries.tokenizer_path()
    own, plain = packing.Tokens(path), packing.Tokens(path)
    long = "x" * 100 + " " + "Y" * 90 + ", short"
    assert own.ids(long.encode()) == plain.ids(long.encode()) and max(map(len, own.words)) <= packing.LONG_WORD
    assert own.bytes == sum(packing.ENTRY_BYTES + 5 * len(k) for k in own.words)
    monkeypatch.setattr(packing, "CACHE_BYTES", 500)
    text = " ".join(f"word{i}" for i in range(100)).encode()
    assert own.ids(text) == plain.ids(text) and not own.words and own.bytes == 0


def test_urls_may_be_in_a_column_that_is_replaced(spark):
    pages = spark.createDataFrame([(1, "http://A.net/x?y", "q"), (2, None, "q")], "page_id long, host string, `a.b` string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    for most in (10, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, url_col="host", max_rules=most).collect()}
        assert got == {1: ("a.net", "/x", "net/", "block"), 2: ("", "", None, "allow")}
