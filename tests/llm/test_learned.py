"""Classifiers: their parts against plain versions, held-out accuracy, and edge rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from seatloom.llm import language, learning, quality, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    a, b = score[label == 1], score[label == 0]
    return ((a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2).item()


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


@pytest.mark.parametrize(("module", "column", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_held_out(tables, module, column, least, edges, nothing):
    docs, labels = tables
    model = module.learn(docs, labels)
    rows = module.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r[column] for r in rows])
    assert auc(score, label) > least and ((score >= 0.3) == label).mean() > 0.93
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert all(0 <= r.score <= 1 for r in module.score(edges, model).collect())
    assert module.score(nothing, model).count() == 0
    same = module.learn(docs, labels)
    assert [r.score for r in module.score(docs.limit(20), same).orderBy("doc_id").collect()] == [r.score for r in module.score(docs.limit(20), model).orderBy("doc_id").collect()]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_nothing_to_learn_from(module, nothing, edges, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score(edges, module.learn(nothing, labels)).collect())
    one = spark.createDataFrame([(k, 1, 1) for k in range(20)] + [(None, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in module.score(edges, module.learn(edges, one)).collect())


def test_keep_good(tables, edges):
    docs, labels = tables
    model = quality.learn(docs, labels)
    want = sorted(str(r.doc_id) for r in quality.score(edges, model).where("predicted = 1").collect())
    kept = quality.keep_good(edges, model)
    assert kept.columns == edges.columns and sorted(str(r.doc_id) for r in kept.collect()) == want


def test_language(tables, edges, nothing):
    docs, _ = tables
    model = language.learn(docs)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.99
    assert all(r.lang_pred in {"en", "de", "fr", "es"} and 0 < r.score <= 1 for r in rows)
    found = {r.doc_id: r.lang_pred for r in language.predict(edges, model).collect()}
    assert [found[k] for k in (0, 1, 2, 3, 5)] == ["und"] * 5 and found[4] != "und"
    assert language.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in language.predict(edges, language.learn(nothing)).collect()} == {"und"}


def plain_features(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    h = [zlib.crc32(t.encode()) for t in tokens]
    mix = 0x9E3779B97F4A7C15
    return {*h, *(((a * mix + b) * mix) % 2**64 for a, b in zip(h, h[1:]))}


def test_quality_score_by_its_parts():
    """Features, class log-count ratios, unit vectors, margin and score against plain versions."""
    rng = random.Random(12)
    good, bad = "the a of fine prose reads well , and so on .".split(), "buy $$$ now !!! 100 cheap click_here the a".split()
    texts = [" ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.randint(3, 30))) for k in range(60)] + ["", "Ünï_9 ,, x"]
    label = np.array([k % 2 for k in range(60)] + [0, 1])
    for t in (*texts, None):
        found = quality.features(t)
        assert set(found.tolist()) == plain_features(t) and (np.diff(found.astype(object)) > 0).all()
    model = quality.fit([quality.features(t) for t in texts], label, {0: 31, 1: 31})
    train = [(plain_features(t), y) for k, (t, y) in enumerate(zip(texts, label)) if k % 5 != 4]
    seen = collections.Counter(x for f, _ in train for x in f)
    kept = sorted(x for x, n in seen.items() if n >= quality.LEAST_DOCUMENTS)
    assert model.ids.tolist() == kept
    tally = {y: {x: 1 + sum(x in f for f, z in train if z == y) for x in kept} for y in (0, 1)}
    ratio = {x: math.log(tally[1][x] / sum(tally[1].values())) - math.log(tally[0][x] / sum(tally[0].values())) for x in kept}
    assert np.allclose(model.ratio, [ratio[x] for x in kept])
    weight = dict(zip(kept, model.weight))
    for t in texts:
        own = [x for x in plain_features(t) if x in ratio]
        length = math.sqrt(sum(ratio[x] ** 2 for x in own)) or 1.0
        margin = sum(weight[x] * ratio[x] / length for x in own) + model.weight[-1]
        assert abs(model.margin(quality.features(t)) - margin) < 1e-9
    scores = learning.sigmoid(model.a * np.array([model.margin(quality.features(t)) for t in texts[:60]]) + model.b)
    assert ((scores >= 0.5) == (label[:60] == 1)).mean() > 0.9


def test_ngrams_by_definition():
    for x in ("", "a", "Ab cd!", "12 é\n\tß日本", "İx", None):
        plain = " " + "".join(c if c.isalpha() else " " for c in (x or "").lower()) + " "
        while "  " in plain:
            plain = plain.replace("  ", " ")
        want = collections.Counter()
        for order in (1, 2, 3):
            for k in range(len(plain) - order + 1):
                h = 0
                for c in plain[k : k + order]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                want[(h * 2654435761 + order) % 2**32 >> 17] += 1
        at, n = language.ngrams(x)
        assert dict(zip(at.tolist(), n.tolist())) == want


def test_ftrl_by_definition():
    """Against the rule for one weight at a time, in double precision."""
    rng = np.random.default_rng(6)
    rows = [(np.array([0, 2, 3]), np.array([0.5, -0.2, 1.0])), (np.array([1, 3]), np.array([0.9, 1.0])), (np.array([2, 3]), np.array([-0.7, 1.0]))]
    label, (epochs, alpha, beta, l1, l2) = [0, 2, 1], (4, 0.8, 1.0, 0.05, 0.1)
    z, n = [[0.0] * 3 for _ in range(4)], [[0.0] * 3 for _ in range(4)]

    def weight(i, c):
        return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(3):
            at, x = rows[k]
            w = [[weight(i, c) for c in range(3)] for i in at]
            e = [math.exp(sum(v * r[c] for v, r in zip(x, w))) for c in range(3)]
            for v, i, r in zip(x, at, w):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == label[k]))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * r[c]
                    n[i][c] += g * g
    got = language.ftrl([(a, x.astype(np.float32)) for a, x in rows], np.array(label), 4, 3, epochs, alpha, beta, l1, l2, 7)
    want = [[weight(i, c) for c in range(3)] for i in range(4)]
    assert np.allclose(got, want, atol=1e-5) and (np.array(want) == 0).tolist() == (got == 0).tolist()
    logits, y = rng.normal(size=(500, 4)) * 3, rng.integers(0, 4, 500)
    y[:350] = logits[:350].argmax(1)
    t = language.fit_temperature(logits, y)
    loss = lambda t: -np.mean([row[k] / t - np.log(np.exp(row / t).sum()) for row, k in zip(logits, y)])
    assert loss(t) <= min(loss(t * 1.05), loss(t / 1.05))


def test_tf_idf_and_sparse_weights():
    rng = np.random.default_rng(8)
    rows = [language.ngrams("".join(rng.choice(list("abcde fg"), 40))) for _ in range(50)]
    label = rng.integers(0, 3, 50)
    model = language.fit(rows, label, ["x", "y", "z"])
    train = [k for k in range(50) if sum(label[:k] == label[k]) % 5 != 4]
    dense = np.zeros((1 << 15, 3))
    for b in range(1 << 15):
        dense[b, model.of[model.start[b] : model.start[b + 1]]] = model.value[model.start[b] : model.start[b + 1]]
    for k in (0, 4, 17):
        at, n = rows[k]
        idf = [math.log((1 + len(train)) / (1 + sum(b in rows[t][0] for t in train))) + 1 for b in at]
        v = np.array([math.log1p(c) * w for c, w in zip(n, idf)])
        v /= np.linalg.norm(v)
        assert np.allclose(model.vector(at, n), v) and np.allclose(model.logits(at, n), v @ dense[at] + model.bias)


def test_many_languages(spark):
    """No cap on languages, and a sample and model that stay small: 300 languages in a process of well under 1.5 GB."""
    import resource

    rng = random.Random(9)
    words = {f"l{k:03}": ["".join(chr((97, 0x3B1, 0x430, 0x561, 0x5D0, 0x10D0)[k % 6] + rng.randrange(24)) for _ in range(rng.randint(2, 5))) for _ in range(12)] for k in range(300)}
    rows = [(9 * i + 1 + j, " ".join(rng.choice(w) for _ in range(25)), lang) for i, (lang, w) in enumerate(words.items()) for j in range(8)]
    rows += [(1, "again and again", "l000")] * 3000  # one id very often: one document
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(df)
    assert len(model.languages) == 300 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1_500_000
    found = language.predict(df.where("doc_id > 1"), model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.8


def test_every_language_is_sampled(spark):
    """6,944 languages of three documents, all in the sample, and a training state of 0.5 GB at most."""
    ids = (k for k in itertools.count() if zlib.crc32(str(k).encode()) % 5)
    df = spark.createDataFrame([(next(ids), f"text {k}", f"l{k % 6944}") for k in range(6944 * 3)], "doc_id bigint, text string, lang string")
    languages, chosen = language.sample(df)
    rows = chosen.collect()
    assert len(languages) == 6944 and {r.lang for r in rows} == set(languages) and len(rows) == 6944
    assert all((1 << language.bucket_bits(n)) * n * 8 <= 1 << 29 for n in (1, 2, 2048, 2049, 6944, 10**6)) and language.bucket_bits(2048) == language.BUCKET_BITS


def test_documents_that_share_an_id(spark):
    """One id, many texts: a language whose rows share it is learned as well as one whose rows don't; copies count once."""
    rng = random.Random(10)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(20))
    texts = [(make("abcdefgh"), "aa") for _ in range(3000)] + [(make("efghijkl"), "bb") for _ in range(6000)]
    df = spark.createDataFrame([(k if lang == "aa" else 7, text, lang) for k, (text, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = language.learn(df)
    for letters, lang in (("abcdefgh", "aa"), ("efghijkl", "bb")):
        assert all(model.predict(make(letters))[0] == lang for _ in range(50))
    one = df.where("lang = 'aa'").unionByName(spark.range(4000).selectExpr("7L as doc_id", "'klkl ijij klij' as text", "'bb' as lang"))
    _, chosen = language.sample(one)
    assert chosen.where("lang = 'bb'").count() == 1 and chosen.where("lang = 'aa'").count() > 500
    assert language.learn(one).predict("klkl ijij klij")[0] == "bb"


def test_whole_texts_are_learned_from(spark):
    """Long texts lose no n-gram: a bound on all n-grams takes fewer documents, and never the first of a language."""
    rng = random.Random(11)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30_000)) for _ in range(8)]
    df = spark.createDataFrame([(k, t, f"l{k % 2}") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    known = [(set(language.ngrams(t)[0].tolist()), k % 2) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5]
    model = language.learn(df, grams=1)  # one document of each language
    seen = set(np.nonzero(model.idf < math.log(3) + 1 - 1e-9)[0].tolist())
    assert seen in [a | b for (a, x), (b, y) in itertools.product(known, known) if (x, y) == (0, 1)]
    assert model.languages == ["l0", "l1"] and len(seen) > 20_000 and language.sample(df)[1].count() == len(known)


def test_coordinate_descent_is_optimal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 1] + rng.normal(size=60) > 0, 1.0, -1.0)
    cost = np.full(60, 0.7)
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = quality.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, cost, epochs=2000, tolerance=1e-9)
    assert all(loss(w) <= loss(w + rng.normal(size=5) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def plain_segments(scores):
    """Maximal scoring segments by the definition: take the best segment, then look left and right of it."""
    def best(a, b):
        top = None
        for i, j in itertools.combinations(range(a, b + 1), 2):
            s = sum(scores[i:j])
            if s > 1e-12 and (top is None or s > top[0] + 1e-9 or (abs(s - top[0]) <= 1e-9 and j - i < top[2] - top[1])):
                top = (s, i, j)
        return top

    def walk(a, b):
        top = best(a, b)
        return [] if top is None else [*walk(a, top[1]), top, *walk(top[2], b)]

    return [(i, j - 1, round(s, 6)) for s, i, j in walk(0, len(scores))]


def test_segments_by_definition():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(0, 14)
        places = [k for k in range(n) if r.random() < 0.5]
        values = [r.choice([3.1, 0.9, 1.7, -0.6, 0.11, 2.3]) + r.random() / 1000 for _ in places]
        scores = [-0.25] * n
        for p, v in zip(places, values):
            scores[p] += v
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(places, values, 0.25)] == plain_segments(scores)


def test_significant_passages_of_clean_texts_are_as_rare_as_stated():
    """Texts of independent tokens: the law fitted on half of them holds on the other half."""
    rng = np.random.default_rng(5)
    score = {"a": 1.6, "b": 2.4, "c": 3.1}
    words, shares = np.array(["a", "b", "c", "x"]), np.array([0.03, 0.02, 0.01, 0.94])
    model = toxicity.ToxicityModel(toxicity.Scores(score))
    texts = [" ".join(rng.choice(words, rng.integers(5, 400), p=shares)) for _ in range(3000)]
    scored = [(n, [s for _, _, s in found]) for n, found, _ in map(model.segments, texts[:1500])]
    model.rate, model.scale = toxicity.fit_law(scored, np.array([1.6, 2.4, 3.1, 0.0]), shares)
    for alpha in (0.01, 0.05, 0.2):
        alarms = np.mean([bool(model.passages(t, alpha)) for t in texts[1500:]])
        assert alarms <= 1.5 * alpha + 0.005
    assert np.mean([bool(model.passages(t, 0.2)) for t in texts]) > 0.05
    rate, scale = toxicity.fit_law([], np.array([2.0, 0.0]), np.array([0.1, 0.9]))
    assert rate > 0 and scale > 0


def test_sum_statistic_by_definition():
    r = random.Random(4)
    for _ in range(200):
        values = [r.uniform(-3, 12) for _ in range(r.randint(0, 6))]
        chances = []
        for k in range(1, len(values) + 1):
            t = sum(sorted(values)[-k:])
            if k > 1 and t <= k * (k - 1):
                break
            chances.append(math.exp(-t) * (t ** (k - 1) if k > 1 else 1) * 2 ** (k - 1) / (math.factorial(k) * math.factorial(k - 1)))
        want = -math.log(min(chances)) if chances else -25
        assert abs(toxicity.sum_statistic(values) - math.copysign(abs(want) ** 0.5, want)) < 1e-9


def test_units_count_contexts_of_other_folds(spark):
    rows = [("you bad man", 1, 0), ("you bad man", 1, 0), ("so bad dog", 1, 1), ("a bad cat", 1, 2), ("you bad man", 1, 3), ("a good cat", 0, 0), ("a good cat", 0, 1), ("bad luck here", 0, 4), (None, 0, 1)]
    rows += [(" ".join(f"w{k}x{j}" for j in range(40)), 0, 3) for k in range(100)]
    df = spark.createDataFrame(rows, "text string, label int, fold int")
    got = {(r.level, r.unit): r for r in toxicity.unit_counts(df).collect()}
    bad = got[0, "bad"]  # contexts: you-man in folds 0 and 3, so-dog in 1, a-cat in 2; clean: start-luck in 4
    assert (bad.toxic, bad.clean, bad.toxic_0, bad.toxic_1, bad.toxic_2, bad.toxic_3, bad.clean_4, bad.clean_0) == (3, 1, 0, 1, 1, 0, 1, 0)
    assert got[0, None].toxic == 6 and all(level in (0, 3, 4, 5, 6) for level, _ in got)


def test_units_that_tell_by_their_own_bound(spark):
    """As log_odds() has it, units of two toxic contexts among them, in all and without a fold."""
    rng = np.random.default_rng(4)
    counts = [(2, 1), (2, 0), (1, 0), (3, 0), (3, 9), *((int(a), int(b)) for a, b in rng.integers(0, 12, (80, 2)) // [1, 3])]
    rows = [(f"u{k}", a, b, int(rng.integers(0, a + 1)), int(rng.integers(0, b + 1))) for k, (a, b) in enumerate(counts)]
    rows.append(("rest", max(0, 600 - sum(a for a, _ in counts)), 400_000, 10, 1000))
    df = spark.createDataFrame(rows, "unit string, toxic bigint, clean bigint, toxic_0 bigint, clean_0 bigint")
    total = {c: sum(r[k] for r in rows) for k, c in enumerate(df.columns) if k}
    for without in (None, 0):
        got = {r.unit for r in df.where(toxicity._tells(total, without)).collect()}
        toxic, clean = (np.array([r[k] - (r[k + 2] if without == 0 else 0) for r in rows], float) for k in (1, 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            delta, z, _ = toxicity.log_odds(toxic, clean)
        want = {r[0] for r, d, x, n in zip(rows, delta, z, toxic + clean) if n and d >= toxicity.LEAST_ODDS and x >= toxicity.LEAST_Z}
        assert got == want and 10 < len(want) < 80
    few = spark.createDataFrame([("u", 2, 1)], "unit string, toxic bigint, clean bigint")
    assert few.where(toxicity._tells({"toxic": 100, "clean": 400_000}, None)).count() == 1


def test_a_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x" * (900 if k % 7 == 0 else 10)) for k in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int")
    found, counts = learning.labelled_sample(docs, labels, "quality", 50, 5, 0, 500)
    rows = found.collect()
    assert {len(r.text) for r in rows} == {10} and all(0 < sum(len(r.text) for r in rows if r.label == k) <= 500 for k in (0, 1))
    assert learning.labelled_sample(docs, labels, "quality", 50, 5, 0)[0].count() == 100 and len(rows) > 60


def test_toxic_score_by_its_parts(tables):
    """score() against a plain walk: token scores, segments by definition, normalised sums, sigmoid."""
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    some = docs.where("length(text) < 160").orderBy("doc_id").limit(60)
    for r, got in zip(some.orderBy("doc_id").collect(), toxicity.score(some, model).orderBy("doc_id").collect(), strict=True):
        words = [w.lower() for w in re.findall(r"\w+", r.text.lower())]
        value = lambda w: next((model.score.by_unit[u] for u in [w, *(w[:k] + "*" for k in (6, 5, 4, 3) if len(w) > k)] if u in model.score.by_unit), 0.0)
        found = plain_segments([value(w) - toxicity.DRIFT for w in words])
        normal = [model.rate * s - math.log(model.scale * max(1, len(words))) for _, _, s in found]
        assert abs(got.score - 1 / (1 + math.exp(-(model.a * toxicity.sum_statistic(normal) + model.b)))) < 1e-4
        assert [(p.first, p.last) for p in got.passages] == [(a, b) for (a, b, _), v in zip(found, normal) if v > -math.log(-math.log(0.99))]


def test_gumbel_rate_and_sigmoid():
    values, shares = np.array([2.0, -0.5]), np.array([0.05, 0.95])
    rate = toxicity.gumbel_rate(values, shares)
    assert abs((shares * np.exp(rate * values)).sum() - 1) < 1e-6 and rate > 0
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = learning.fit_sigmoid(x, y, np.ones(4000))
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3
