"""Toxicity, language and quality: held-out accuracy, defined results for odd rows, exact inference."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caselight.llm import langid, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"


def auc(score, y):
    r = pd.Series(score).rank().to_numpy()
    y = np.asarray(y)
    n1, n0 = y.sum(), (1 - y).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id")


def scored(spark, name):
    return queries.queries()[name](spark, DATA).toPandas()


@pytest.mark.parametrize("name,label,modulus,held,least", [("op1_toxicity", "toxic", 3, 1, 0.85), ("op8_quality", "quality", 5, 0, 0.95)])
def test_held_out(spark, labels, name, label, modulus, held, least):
    got = scored(spark, name)
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % modulus == held for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= (0.7 if label == "toxic" else 0.3))).all()
    h = got[got.held_out].set_index("doc_id").join(labels, how="inner")
    assert auc(h.score.to_numpy(), h[label].to_numpy()) > least


def test_language_held_out(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    got = scored(spark, "op7_language_id").set_index("doc_id").join(docs)
    h = got[got.held_out]
    assert (h.lang_pred == h.lang).mean() > 0.98 and (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.index]).all()


def brute_marginals(u, trans):
    n = len(u)
    total, toxic = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(u[i] for i in range(n) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        toxic += w * np.array(path)
    return toxic / total


def test_marginals_are_exact():
    rng = np.random.default_rng(6)
    trans = rng.normal(size=(2, 2))
    lengths = np.array([9, 7, 7, 3, 1])
    u = np.where(np.arange(9) < lengths[:, None], rng.normal(scale=2, size=(5, 9)), 0)
    odds = toxicity._marginals(u, trans, lengths)[2]
    for r, n in enumerate(lengths):
        assert np.allclose(1 / (1 + np.exp(-odds[r, :n])), brute_marginals(u[r, :n], trans))


def corpus_of(spark, n=300):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{x}" for x in rng.integers(0, 60, rng.integers(5, 80))]
        toxic = int(rng.random() < 0.4)
        if toxic:
            for x in rng.integers(0, len(w), 4):
                w[x] = str(rng.choice(["vile", "Nasty!", "rotten"]))
        rows.append((i, " ".join(w), "en", None, 0))
        labels.append((i, 1 - toxic, toxic))
    rows += [(None, "vile nasty rotten", None, None, 0), (1000, None, None, None, 0), (1001, "", "en", None, 0), (1002, "w1 " * 30000 + "vile rotten nasty", "en", None, 0), rows[0]]
    labels += [(None, 0, 1), (5, None, None), (7, 0, 1), (7, 1, 0), (4000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_spans(spark):
    docs, labels = corpus_of(spark)
    chain = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, chain).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert got[1002].predicted == 1 and got[1000].predicted == got[1001].predicted == 0
    text = b"w1 w2 Vile, nasty! w3 w4 w5 rotten w6"
    found = [text[a:b] for a, b, _ in chain.spans(text)]
    assert b"".join(found).count(b"w") == 0 and b"rotten" in found[-1] and b"Vile" in found[0]
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_nothing_to_learn_from(spark):
    docs, labels = corpus_of(spark, 20)
    none = labels.where("false")
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, none)).collect())
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = corpus_of(spark)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_language_odd_rows(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("der die das und nicht", "de"), ("the and of with this", "en")] * 20)]
    rows += [(100, None, "en"), (101, "12 34 !!", None), (102, "", None), (None, "the and", "en"), (103, "the und of " * 20000, None), (104, "größe und über", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[None].lang_pred == "en" and got[104].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())


def brute_grams(text):
    """Buckets of the n-grams, one character after the other."""
    s, found = " ".join([""] + text.lower().split() + [""])[(not text[:1].isspace()) :], []
    s = s if text[-1:].isspace() else s[:-1]
    for n in langid.LENGTHS:
        for i in range(len(s) - n + 1):
            h = 0
            for k, c in enumerate(s[i : i + n]):
                h = (h * 0x01000193 + ord(c) + k + 1) % (1 << 32)
            found.append((h * 0x9E3779B1) % (1 << 32) >> 17)
    return found


@pytest.mark.parametrize("block", [512, 2])
def test_language_predictions_equal_brute_force(spark, block):
    rows = [("the cat and the dog", "en"), ("THE end of it all", "en"), ("der Hund und die Katze", "de"), ("größe über alles", "de"), ("বাংলা ভাষা", "bn"), ("le chat et le chien", "fr"), ("বই পড়া", "bn"), ("", "fr")]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs, modulus=1, held=5, block=block)
    asked = ["the dog", "und", "ভাষা", "chien", "x", "a  b\n", "", "ﬁne İstanbul"]
    langs = sorted({g for _, g in rows})
    assert model.langs == langs and len(model.blocks) == (1 if block > 3 else 2)
    counts = {g: Counter(b for t, x in rows if x == g for b in brute_grams(t)) for g in langs}
    for t, got in zip(asked, langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect(), strict=True):
        if not any(c.isalpha() for c in t):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        log = []
        for g in langs:
            total = sum(counts[g].values()) + langid.BUCKETS * langid.ALPHA
            log.append(math.log(sum(x == g for _, x in rows)) + sum(math.log((counts[g][b] + langid.ALPHA) / total) for b in brute_grams(t)))
        p = np.exp(np.array(log) - max(log))
        assert got.lang_pred == langs[int(p.argmax())] and got.score == pytest.approx(p.max() / p.sum(), abs=1e-3)


def test_only_letters_are_letters():
    assert not any(langid.has_letter(t.encode()) for t in ("½ ² ① Ⅷ", "12_3", "", "\u0301", "!?")) and all(langid.has_letter(t.encode()) for t in ("½a", "ক", "ʰ", "\u01c5"))


def test_repeated_rows_train_once(spark):
    rows = [(i, "common " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) + (" vile rotten nasty" if i % 2 else ""), "x") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(70)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string, y string")
    many = spark.createDataFrame(rows + rows[1:2] * 40 + rows[:1] * 3, "doc_id long, text string, y string")
    found = [{r.doc_id: round(r.score, 9) for r in toxicity.score(once, toxicity.fit(d, labels, modulus=1, held=5)).collect()} for d in (once, many)]
    assert found[0] == found[1] and max(found[0].values()) > 0.5


def test_offsets_are_the_runs_of_likely_words():
    chain = toxicity.Chain(np.zeros(toxicity.DIM, np.float32), -3.0, np.zeros((2, 2)))
    for w in (b"vile", b"nasty"):
        chain.weights[list(toxicity.features(w))] = 3.0
    texts = ["  Vile, nasty!\tw1 größe vile\n".encode(), b"", b"w1 w2", b"x " * 300 + b"NASTY"]
    for t, p in zip(texts, chain.marginals(texts), strict=True):
        words, at = [], 0
        for w in t.split():
            at = t.index(w, at)
            words.append((at, at + len(w)))
            at += len(w)
        u = np.array([9.0 if t[a:b].lower().strip(b",!") in (b"vile", b"nasty") else -3.0 for a, b in words])
        assert np.allclose(p, 1 / (1 + np.exp(-u)), atol=1e-3)  # without transitions words are independent
        want, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and p[j] >= 0.5:
                j += 1
            if j > i:
                want.append((words[i][0], words[j - 1][1], pytest.approx(max(p[i:j]))))
            i = max(j, i + 1)
        assert chain.spans(t) == want


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (120, quality.N_FEATURES)).astype(float)
    y = (rng.random(120) < 0.2 + 0.1 * x[:, 4]).astype(float)
    w = rng.random(120) + 0.5
    m = quality.boost(x, y, w)
    p = (w * y).sum() / w.sum()
    g, h = w * (y - p), w * p * (1 - p)
    gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c) - gain(x[:, j] < 9), -j) for j in range(x.shape[1]) for c in range(5)
               if min(h[x[:, j] <= c].sum(), h[x[:, j] > c].sum()) >= quality.LEAST_WEIGHT / 8)
    j, c = m.feature[0][0], m.cut[0][0]
    assert gain(x[:, j] <= c) + gain(x[:, j] > c) - gain(x[:, j] < 9) == pytest.approx(best[0])


def test_statistics_of_small_texts():
    s = quality.statistics(b"Ab c. Ab\n\nx1")
    assert s[0] == pytest.approx(math.log1p(12)) and s[10] == pytest.approx(math.log1p(4)) and s[11] == pytest.approx(7 / 4 + 0.25)
    assert s[14] == 3 / 4 and s[15] == 2 / 4 and s[17] == 2 / 4 and s[19] == 1 and s[20] == 1 / 4 and s[21] == 2 / 4 and s[22] == 1
    assert not quality.statistics(b"").any() and quality.statistics(b" \n")[10] == 0


def test_quality_odd_rows(spark):
    docs, labels = corpus_of(spark, 60)
    clash = docs.withColumn("held_out", F.lit("x")).withColumn("t", F.lit(1))
    got = quality.score(clash, quality.fit(clash, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in got)
    same = [r.score for r in got if r.doc_id == 0]
    assert len(same) == 2 and same[0] == same[1] and all(r.held_out is False for r in got if r.doc_id is None)


def test_trees_walk_like_recursion():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, quality.N_FEATURES))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    m = quality.boost(x, y, np.ones(400))
    assert (((m.logits(x) > 0) == (y > 0)).mean()) > 0.95

    def walk(row):
        out = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + (row[f[i]] > c[i])
            out += leaf[i - len(f)]
        return out

    assert np.allclose([walk(r) for r in x[:50]], m.logits(x[:50]))
