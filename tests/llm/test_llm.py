import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phytomill.llm import clusters, knn, leaks, mixing, sample, splits, subjects, topn, vectors


def test_top_n(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(9)}", rng.randrange(30), rng.randrange(-5, 500), "x") for _ in range(3000)]
    rows += rows[:50] + [(None, 1, 1, "x"), ("g1", None, 1, "x"), ("g1", 1, None, "x"), ("one", 5, 5, None)]
    df = spark.createDataFrame(rows, "g string, s bigint, i bigint, c string")
    best = {}
    for g, s, i, _ in rows:
        if None not in (g, s, i):
            best[g, i] = max(s, best.get((g, i), -1))
    for n, fanout in ((4, 32), (1, 2), (1000, 3), (0, 2)):
        want = set()
        for g in {g for g, _ in best}:
            own = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:n]
            want |= {(g, i, -s) for s, i in own}
        assert {tuple(r) for r in topn.top_n_per_group(df, "g", "s", "i", n, fanout).collect()} == want
    assert topn.top_n_per_group(df.limit(0), "g", "s", "i", 3).count() == 0
    far = [("a", k % 7 * (1 << 59) - (1 << 61), 1 << k) for k in range(60)] + [("b", (-1) ** k * (1 << 62), k - (1 << 62)) for k in range(9)]
    got = {tuple(r) for r in topn.top_n_per_group(spark.createDataFrame(far, "g string, s bigint, i bigint"), "g", "s", "i", 11, 5).collect()}
    assert got == {(g, i, s) for h in "ab" for g, s, i in sorted((r for r in far if r[0] == h), key=lambda r: (-r[1], r[2]))[:11]}
    wide = spark.createDataFrame([("a", -(1 << 61), 1), ("a", 1 << 61, 1 << 40), ("a", 7, 9)], "g string, s bigint, i bigint")
    assert {r["i"] for r in topn.top_n_per_group(wide, "g", "s", "i", 2).collect()} == {1 << 40, 9}


def test_components_and_splits(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(300)]), rng.choice([None, *range(400, 640)]), rng.choice(["p", "q", None])) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, obs bigint, taxon bigint, kind string")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, o, t, _ in rows:
        for other in ([("o", o)] if o is not None else []) + ([("t", t)] if t is not None else []):
            parent[find(("r", k))] = find(other)
    got = {r.id: r.component for r in splits.components(df, "id", "obs", "taxon").collect()}
    assert len({(got[k], find(("r", k))) for k in got}) == len(set(got.values())) == len({find(("r", k)) for k in got})
    small = spark.createDataFrame([(k, f"g{k // 3}", "p" if k % 2 else "q") for k in range(3000)] + [(9999, None, "p")], "id bigint, g string, l string")
    done = splits.assign_groups(small, "g", "l", {"train": 0.8, "validation": 0.1, "test": 0.1})
    parts = done.groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).filter("g is not null").collect()
    assert all(r.n == 1 for r in parts)
    share = {r.split: r["count"] / 3000 for r in done.filter("g is not null").groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    tiny = spark.createDataFrame([(k, f"g{k // 2}", f"l{k // 6}") for k in range(12_000)], "id bigint, g string, l string")  # three groups a label
    balance = splits.split_balance(splits.assign_groups(tiny, "g", "l", {"train": 0.8, "validation": 0.1, "test": 0.1}), "l", {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert all(abs(r.deviation) < 0.015 for r in balance.filter("label is null").collect()) and balance.filter("label is not null").count() == 6000
    assert done.filter("g is null").first().split is None
    assert splits.assign_groups(small.limit(0), "g", "l", {"a": 1.0}).count() == 0
    assert splits.propagate_labels(spark.createDataFrame([], "r bigint, e bigint"), "r", "e").count() == 0
    chain = spark.createDataFrame([(k // 2, (k + 1) // 2) for k in range(200)], "r bigint, e bigint")
    assert {r.label for r in splits.propagate_labels(chain, "r", "e").collect()} == {0}


def test_ledger(spark, tmp_path):
    first, later = spark.range(200).select(F.col("id").alias("k")), spark.range(500).select(F.col("id").alias("k"))
    keys = lambda df: {r.k for r in df.collect()}
    a = keys(sample.grow_ledger(first.union(first), f"{tmp_path}/l", "k", 0.2, 1))
    # what another process finds is only what lies in the folder
    b = keys(sample.grow_ledger(later.repartition(5), f"{tmp_path}/l", "k", 0.2, 2))
    assert len(a) == 40 and len(b) == 100 and a < b
    assert keys(sample.grow_ledger(later, f"{tmp_path}/l", "k", 0.9, 2)) == b == keys(sample.load_ledger(spark, f"{tmp_path}/l"))  # a step is drawn once
    assert keys(sample.grow_ledger(first.limit(0), f"{tmp_path}/l", "k", 0.2, 3)) == b
    assert keys(sample.grow_ledger(first.repartition(7), f"{tmp_path}/m", "k", 0.2, 1)) == a
    (tmp_path / "n" / ".step-000001-dead").mkdir(parents=True)  # left by a run that died
    assert keys(sample.grow_ledger(first, f"{tmp_path}/n", "k", 0.2, 1)) == a
    assert keys(sample.grow_ledger(first.limit(0), f"{tmp_path}/o", "k", 0.2, 1)) == set()


def points(spark, n=900, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(12, size=n)] + rng.normal(size=(n, dims)) * (0.35 if dims < 32 else 0.5)
    rows = [(k, [float(v) for v in r], "a") for k, r in enumerate(x)]
    rows += [(n + k, rows[5][1], "a") for k in range(300)]  # a quarter of all rows are copies of one
    bad = [(-1, None, "b"), (-2, [0.0] * dims, "b"), (-3, [1.0], "b"), (-4, [float("nan")] * dims, "b"), (-5, [None] * dims, "b")]
    return spark.createDataFrame(rows + bad, "id bigint, embedding array<float>, sims string"), rows


def test_nearest(spark):
    df, rows = points(spark)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = df.filter("id % 20 = 0 or id < 0").select(F.col("id").alias("q"), "embedding")
    got = {}
    for r in knn.nearest(asked, df, 4, "q", "id", dims=16, window=150).collect():
        got.setdefault(r.q, set()).add(r.id)
    hit = 0
    for q, ids in got.items():
        s = np.round(x @ x[q], 5)
        hit += len(ids & set(np.lexsort((np.arange(len(s)), -s))[:4].tolist()))
    assert len(got) == 60 and hit / 240 >= 0.9
    assert all(r.query_id != r.id for r in knn.nearest(df.limit(200), df, 2, "id", "id", dims=16, same=True).collect())
    assert knn.nearest(asked.limit(0), df, 2, "q", "id", dims=16).count() == 0 and knn.nearest(asked, df.filter("id < 0"), 2, "q", "id", dims=16).count() == 0


def exact_nearest(asked, index, k):
    """{query id: [index ids]} by brute force; both sides {id: vector}."""
    ids = np.array(sorted(index))
    x = np.array([index[i] for i in ids], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q, v in asked.items():
        v = np.array(v, dtype=np.float32).astype(float)
        s = np.round(x @ (v / np.linalg.norm(v)), 5)
        out[q] = ids[np.lexsort((ids, -s))[:k]].tolist()
    return out


def found_nearest(frame):
    got = {}
    for r in frame.orderBy("q", F.desc("similarity"), "id").collect():
        got.setdefault(r.q, []).append(r.id)
    return got


@pytest.mark.parametrize("noise", [0.01, 0.0001])
def test_nearest_where_it_is_dense(spark, noise):
    rng = np.random.default_rng(6)
    one = rng.normal(size=64) / 8
    x = np.concatenate([rng.normal(size=(6000, 64)), one + rng.normal(size=(6000, 64)) * noise])  # half of the rows in one direction
    x = {k: r.tolist() for k, r in enumerate(x)}
    index = spark.createDataFrame(list(x.items()), "id bigint, embedding array<float>").repartition(3)
    asked = {k: x[k] for k in range(0, 12000, 20)}
    queries = spark.createDataFrame(list(asked.items()), "q bigint, embedding array<float>")
    got, want = found_nearest(knn.nearest(queries, index, 3, "q", "id", window=2048)), exact_nearest(asked, x, 3)
    for part in (range(0, 6000, 20), range(6000, 12000, 20)):
        assert sum(len(set(got[q]) & set(want[q])) for q in part) / (3 * len(part)) >= 0.9


def test_nearest_orders_copies_of_one_direction_by_id(spark):
    rng = np.random.default_rng(7)
    x = {int(k): r.tolist() for k, r in zip(rng.permutation(3000), rng.normal(size=(3000, 64)))}
    one, two = np.array(x[11]), np.array(x[22])
    for k in range(3000, 3040):
        x[k] = (one * (1 + k % 37 / 7)).tolist()  # equal cosine, different vectors
    for k in range(3040, 3080):
        x[k] = (two + rng.normal(size=64) * 2e-3).tolist()  # closer than bytes can tell
    places = dict(zip(x, rng.permutation(len(x)).tolist()))
    x = {places[k]: v for k, v in x.items()}
    asked = {places[k]: x[places[k]] for k in [11, 22, *range(3000, 3080)]}
    index = spark.createDataFrame(list(x.items()), "id bigint, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "q bigint, embedding array<float>")
    assert found_nearest(knn.nearest(queries, index, 3, "q", "id")) == exact_nearest(asked, x, 3)
    within = knn.nearest(queries.withColumnRenamed("q", "id"), index, 3, "id", "id", same=True).withColumnRenamed("query_id", "q")
    assert found_nearest(within) == {q: [i for i in ids if i != q][:3] for q, ids in exact_nearest(asked, x, 4).items()}


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = vectors.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_clusters(spark):
    df, rows = points(spark, dims=32)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = clusters.cluster(df, "id", dims=32)
    by = {}
    for r in got.collect():
        by.setdefault(r.cluster_id, []).append(r.id)
    assert len(by) >= 8
    assert any({5, *range(900, 1200)} <= set(m) for m in by.values())
    for c, members in by.items():
        mean = x[members].sum(axis=0)
        mean /= np.linalg.norm(mean)
        assert c == min(members) and len(members) >= 10 and (x[members] @ mean >= 0.7 - 1e-4).all()
    described = clusters.describe(got, df, "id", "sims").collect()
    assert {r.cluster_id: r["size"] for r in described} == {c: len(m) for c, m in by.items()} and all(len(r.typical) == 5 for r in described)
    assert clusters.cluster(df.limit(0), "id", dims=32).count() == 0


def test_rounds_touch_changed_labels_only(spark, monkeypatch):
    df, rows = points(spark, dims=32)
    plain, seen = clusters.means, []

    def counting(members, *args):
        seen.append(members.count())
        return plain(members, *args)

    monkeypatch.setattr(clusters, "means", counting)
    got = clusters.cluster(df, "id", dims=32).collect()
    assert len(seen) > 1 and seen[-1] < seen[0] / 2  # a round once took every vector's mean and cosine again
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for c in {r.cluster_id for r in got}:
        members = [r for r in got if r.cluster_id == c]
        mean = x[[r.id for r in members]].sum(axis=0)
        assert all(abs(r.similarity - x[r.id] @ mean / np.linalg.norm(mean)) < 1e-4 for r in members)


def test_lists_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[300:350] = x[:50]  # equal cosines
    df = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(x)], "id bigint, vec binary").repartition(3)
    args = (df, None, 400, 400, 6, 16, 3, 150, True, 6, True, 2)
    want = {(r.qid, r.iid, r.s) for r in knn.best_hits(knn.window_hits(*args).filter("s >= 0.3"), 6).collect()}
    got = knn.window_hits(*args, 0.3).collect()
    assert len(got) == len(want) > 400 and {(r.qid, r.iid, r.s) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append((r.pos, -r.s, r.iid))
    assert all([p for p, _, _ in sorted(v)] == list(range(len(v))) and [v_[1:] for v_ in sorted(v)] == sorted(v_[1:] for v_ in v) for v in by.values())
    assert knn.window_hits(*args, 1.5).count() == 0


def test_density_peaks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 24))[rng.integers(6, size=700)] + rng.normal(size=(700, 24)) * 0.5
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    vectors = spark.createDataFrame([(k, bytearray(r.tobytes()), 1) for k, r in enumerate(x)], "id bigint, vec binary, w bigint").repartition(3)
    lists = clusters.neighbours(vectors, 700, 5, 0.5, 24, 2, 1024, 1)
    rho = clusters.density(lists, vectors, None)
    got = {r.id: r.peak for r in clusters.peaks(vectors, rho, lists, 5, 0.5, 24, 2, 1024, 1).collect()}
    sent = clusters.V.unit(clusters.V.unit(x).astype(np.float16))  # vectors travel in half precision
    s = sent @ sent.T
    np.fill_diagonal(s, -1)
    own = {r.id: r.rho for r in rho.collect()}
    kth = np.sort(s, axis=1)[:, -5:]
    assert all(abs(own[k] - 1e6 - np.rint(kth[k][kth[k] >= 0.5] * 1e6).sum()) <= 5 for k in own)
    d = np.array([own[k] for k in range(700)])
    denser = (d[None, :] > d[:, None]) | ((d[None, :] == d[:, None]) & (np.arange(700)[None, :] < np.arange(700)[:, None]))
    reach = np.where(denser & (s >= 0.5), s, -1)
    lone = {k for k in range(700) if reach[k].max() < 0}  # no denser vector that near: the peaks
    assert set(got.values()) == lone
    assert sum(got[k] == got[int(reach[k].argmax())] for k in range(700) if k not in lone) > 600


def test_leaks(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    a, b = passage(40), passage(40)
    altered = [w if k % 9 else "new" for k, w in enumerate(a)]
    docs = [(1, " ".join(passage(50) + altered + passage(50))), (2, " ".join(a[:8])), (3, "<p>" + "<br/>".join(b[:22]).upper() + "</p>"), (4, None), (5, "  "), (6, " ".join(b[20:] + passage(2000) + b[:20])), (6, " ".join(b))]
    docs = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(k, "Read this with care. " + " ".join(w)) for k, w in ((10, a), (11, b), (12, passage(30)))] + [(13, None), (14, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()}
    assert got == {(1, 10), (3, 11), (6, 11)}
    cut = {r.doc_id: r for r in leaks.remove_leaks(docs.filter("doc_id <> 6"), items).collect()}
    assert cut[1].removed_words >= 35 and cut[2].removed_words == 0 and cut[4].text is None and cut[5].text == "  "
    assert {r.doc_id for r in leaks.remove_leaks(docs, items, whole=True).collect()} == {2, 4, 5}
    assert leaks.find_leaks(docs.limit(0), items).count() == 0 and leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_mix(spark):
    for mean, most in ((0.5, 2), (1.7, 3), (0.01, 1), (900.0, 1000)):
        assert abs(mixing.truncated_mean(mixing.rate_for(mean, most), most) - mean) < 1e-6
    docs = [(k, ["big", " BIG", "mid", "tiny"][0 if k < 1500 else 1 if k < 2000 else 2 if k < 2900 else 3], 100) for k in range(3000)] + [(5000, None, 9), (5001, "other", 100), (5002, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("Big", 0.4, 1), ("mid", 0.4, 3), ("tiny", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mix(sized, targets)
    assert {r.source for r in plan.filter("not reachable").collect()} == {"tiny"}
    mix = mixing.draw_mix(sized, plan)
    first = sorted(tuple(r) for r in mix.collect())
    assert first == sorted(tuple(r) for r in mixing.draw_mix(sized.repartition(7), plan).collect())
    report = {r.source: r for r in mixing.report_mix(mix, plan).collect()}
    assert report["tiny"].drawn == 2 * 100 * 100 and report["mid"].most_copies <= 3 and report["none"].drawn == 0
    assert abs(report["Big"].drawn / report["mid"].drawn - 1) < 0.12
    assert abs(report["mid"].share_of_aim - 0.4) < 0.05 and report["mid"].feasible_size == 100_000
    small = mixing.plan_mix(sized, targets, target_size="feasible")
    shares = {r.source: r.actual_share for r in mixing.report_mix(mixing.draw_mix(sized, small), small).collect()}
    assert all(abs(shares[s] - t) < 0.05 for s, t in (("Big", 0.4), ("mid", 0.4), ("tiny", 0.2)))
    twice = mixing.plan_mix(sized, spark.createDataFrame([("mid", 0.1, 1), (" MID", 0.2, 2)], targets.schema))
    assert [(round(r.target_share, 9), r.max_repeats) for r in twice.collect()] == [(0.3, 2)]
    counted = mixing.count_tokens(spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "doc_id bigint, text string"))
    assert {r.doc_id: r.tokens for r in counted.collect()} == {1: 2, 2: 0, 3: 0}
    assert mixing.report_mix(mixing.draw_mix(sized.limit(0), mixing.plan_mix(sized.limit(0), targets)), plan).count() == 4


def test_subjects(spark):
    rng = random.Random(5)
    own = {"law": [f"law{chr(97 + k)}" for k in range(20)], "food": [f"dish{chr(97 + k)}" for k in range(20)]}
    both = [f"plain{chr(97 + k)}" for k in range(20)]

    def text(kinds):
        return " ".join(" ".join(rng.sample(own[k], 3) + rng.sample(both, 3)).capitalize() + "." if k else "See page nine." for k in kinds)

    docs, truth = [], set()
    for d in range(300):
        kinds = rng.choice([["law"] * 5, ["food"] * 5, ["law"] * 3 + ["food"] * 3, ["law"] * 5 + ["food"], [None] * 4])
        docs.append((d, text(kinds), "s"))
        truth |= {(d, k) for k in own if kinds.count(k) >= 0.3 * len(kinds)}
    df = spark.createDataFrame([*docs, (900, None, "s"), (901, " ", None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(d, s) for d, s in sorted(truth) if d % 3 == 0] + [(1, None), (None, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("law", "statutes and courts"), ("food", None)], "subject string, description string")
    model = subjects.fit_subjects(df, labels, areas, hint="source")
    got = {(r.doc_id, r.subject) for r in subjects.assign_subjects(df, model).collect()}
    assert len(got & truth) / len(got | truth) > 0.97
    assert subjects.assign_subjects(df.limit(0), model).count() == 0
    empty = subjects.fit_subjects(df.limit(0), labels, areas)
    assert subjects.assign_subjects(df, empty).count() == 0


def test_rare_subjects_keep_their_rules(spark):
    common = [([f"word{k % 7}", f"more{k % 5}"], ("law", "food")[k % 2]) for k in range(20_000)]
    rare = [(["mossa", "word1"] if k < 4 else ["left", "right"] if k < 8 else ["word2"], "moss") for k in range(20)]
    split = [([t], s) for t in ("left", "right") for s in ("law", "food") for _ in range(2)]  # neither word tells, both do
    rules = subjects.mine_rules(spark.createDataFrame(common + rare + split, "terms array<string>, subject string"))
    got = {tuple(r.terms): (r.subject, r.hits, r.seen) for r in rules.collect()}
    assert got[("mossa",)] == ("moss", 4, 4) and got[("left", "right")] == ("moss", 4, 4)


@pytest.mark.parametrize("text, n", [("One two. Three!", 2), ("Rosa alba var. minor grows.", 1), (None, 0), ("  ", 0)])
def test_sentences(text, n):
    assert len(subjects.sentences(text)) == n
