"""SimHash, line, substring and embedding dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caselight.llm import common, embdedup, linededup, shingledup, simhash, substring


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spark_hash_is_xxh64(spark):
    for t in ("", "abc", "größe " * 20):
        assert spark.range(1).select(F.xxhash64(F.lit(t)).alias("x")).first().x % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


def brute_fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_masks_cover():
    ms = [m % (1 << 64) for m in simhash.masks(3)]
    rng = random.Random(1)
    for _ in range(2000):
        d = sum(1 << i for i in rng.sample(range(64), 3))
        assert any(not d & m for m in ms)


def test_simhash(corpus):
    df, rows = corpus
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    comp = union_find(range(len(fps)), links)
    low = defaultdict(list)
    for i, c in comp.items():
        if rows[i][0] is not None:
            low[c].append(rows[i][0])
    want = Counter((rows[i][0], f"{fps[i]:016x}", min(low[comp[i]], default=None)) for i in range(len(fps)))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).drop("fp").collect()) == want


def test_simhash_blocks_of_a_hot_bucket(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    xs = {centre}
    for _ in range(400):
        xs.add(rng.choice(list(xs)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)))
    xs |= {rng.getrandbits(63) for _ in range(100)}
    want = union_find(xs, [(a, b) for a in xs for b in xs if a < b and (a ^ b).bit_count() <= 3])
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in xs], "fp long"), block=16)
    got = [(r.a, r.b) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got) and len(got) < len(xs) * 200
    assert union_find(xs, got) == want


def test_simhash_keeps_one_of_each_group(corpus, empty):
    df, _ = corpus
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect() if r.doc_id is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(found.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_representatives(empty).count() == 0


def test_line_dedup(corpus, empty):
    df, rows = corpus
    run = linededup.GRAM + linededup.WINDOW - 1
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest((t or "").encode(), 42)) if t is not None else 42
    docs = {}
    for d, t in rows:
        ls = (t or "").split("\n") if t is not None else []
        docs[d, t] = ls
    first = {}
    grams = defaultdict(list)
    for (d, t), ls in docs.items():
        full = [(i, x.strip(linededup.BLANKS)) for i, x in enumerate(ls) if x.strip(linededup.BLANKS)]
        for s in range(len(full) - run + 1):
            key = tuple(x for _, x in full[s : s + run])
            place = (d is None, d if d is not None else 0, signed(t), s)
            first[key] = min(first.get(key, place), place)
            grams[d, t].append((key, place, [i for i, _ in full[s : s + run]]))
    want = Counter()
    for d, t in rows:
        gone = {i for key, place, at in grams[d, t] if place != first[key] for i in at}
        kept = None if t is None else "\n".join(x for i, x in enumerate(docs[d, t]) if i not in gone)
        want[d, kept, len(docs[d, t]), len(gone)] += 1
    got = linededup.dedup_lines(df)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert sum(k[3] for k in want) > 50
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and linededup.dedup_lines(empty).count() == 0


def test_line_dedup_with_its_own_names_as_columns(spark):
    import re
    from pathlib import Path

    names = sorted(set(re.findall(r'"([a-z_]+)"', Path(linededup.__file__).read_text())) - {"doc_id", "text", "merge", "left"} | {"gone", "ps"})
    names = [n for n in names if not n.startswith("__line_")]
    df = spark.createDataFrame([(i, "a b\nc d\ne f\ng h" if i < 3 else "x\ny") for i in range(5)], "doc_id long, text string")
    got = linededup.dedup_lines(df.select("*", *[F.lit(7).alias(n) for n in names])).collect()
    assert {(r.doc_id, r.n_removed, r.text) for r in got} == {(0, 0, "a b\nc d\ne f\ng h"), (1, 4, ""), (2, 4, ""), (3, 0, "x\ny"), (4, 0, "x\ny")}


@pytest.mark.parametrize("k,w", [(1, 1), (2, 2), (1, 3), (3, 4)])
def test_selected_fingerprints(spark, k, w):
    """Every window has its selected gram, fewer rows than windows go on, and without them nothing is found."""
    rng = random.Random(3)
    docs = [[f"l{rng.randrange(9)}" for _ in range(n)] for n in (0, 1, 3, 5, 6, 30, 200)]
    df = spark.createDataFrame([(i, "\n\n".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = linededup.fingerprints(df, k, w).collect()
    covered = Counter((r.doc_id, s) for r in got for s in range(r.lo, r.hi + 1))
    assert covered == {(i, s): 1 for i, d in enumerate(docs) for s in range(1, len(d) - k - w + 3)}
    assert all(r.lo <= r.at <= r.lo + w - 1 and r.hi <= r.at <= r.hi + w - 1 and len(r.around) == r.hi - r.lo + k + w - 1 for r in got)
    assert len({(r.doc_id, r.at) for r in got}) == len(got) and (w == 1 or len(got) < 0.9 * len(covered))
    # brute force: a line goes if a window with it stands earlier
    first, gone = {}, defaultdict(set)
    for i, d in enumerate(docs):
        for s in range(len(d) - k - w + 2):
            if first.setdefault(tuple(d[s : s + k + w - 1]), (i, s)) != (i, s):
                gone[i] |= set(range(s, s + k + w - 1))
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(df, k, w).collect()} == {i: len(gone[i]) for i in range(len(docs))}


def test_rows_go_not_ids(spark):
    text, own = "one two three four five six seven eight nine ten", "quite another text of its own that nobody else has written down"
    rows = [(3, text), (5, own), (5, text), (None, text), (None, "rows without an id keep what only they have to say here"), (7, "same id"), (7, "same  id"), (9, own)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, th long")
    for keep in (simhash.keep_representatives, shingledup.keep_representatives):
        got = sorted(str(r.doc_id) + r.text for r in keep(df).collect())
        assert len(got) == 4 and "3" + text in got and "5" + own in got and sum(g.startswith("7same") for g in got) == 1, got


def test_line_dedup_runs_no_python(corpus):
    plan = linededup.dedup_lines(corpus[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("width", [5, 35])
def test_substring_dedup(corpus, empty, width):
    df, rows = corpus
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[s : s + width]) for w in words for s in range(len(w) - width + 1))
    want = Counter()
    for (d, _), w in zip(rows, words, strict=True):
        gone = {i for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1 for i in range(s, s + width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring.remove_repeats(df, width).collect()) == want
    assert substring.remove_repeats(empty, width).count() == 0


def parsed(texts, levels):
    x = substring.Symbols.of_words(*substring.word_hashes(texts))
    for r in range(levels):
        x.level(r)
    return x


@pytest.mark.parametrize("levels", [1, 3, 5, 7])
def test_windows_are_equal_as_their_symbols_are(levels):
    rng = np.random.default_rng(4)
    part = b" ".join(rng.choice([b"a", b"b", b"c", b"dd", b"the"], 80))
    noise = [b" ".join(rng.choice([b"a", b"b", b"q", b"r"], n)) for n in (50, 70, 33, 90)]
    texts = [noise[0] + b" " + part + b" " + noise[1], noise[2] + b" " + part, part + b" " + noise[3], b"z " * 200, b"", b"x y " * 60]
    x = parsed(texts, levels)
    alive = x.starts(35)
    at = np.flatnonzero(alive)
    words = [w for t in texts for w in t.split()]
    by_words, by_key, inner = defaultdict(set), defaultdict(set), defaultdict(set)
    for s, k in zip(at, zip(*(v.tolist() for v in x.keys(at, 35)), strict=True), strict=True):
        w = tuple(words[s : s + 35])
        by_words[w].add(k)
        by_key[k].add(w)
        own = (x.left >= s) & (x.right <= s + 35)
        inner[w].add(tuple(zip(x.name[own].tolist(), (x.start[own] - s).tolist(), strict=True)))
    assert all(len(v) == 1 for d in (by_words, by_key, inner) for v in d.values()) and len(by_words) < len(at)
    assert (x.interior(alive, 35) == [((x.left[i] >= at) & (x.right[i] <= at + 35)).any() for i in range(len(x.name))]).all()
    dead = np.flatnonzero(x.interior(alive, 35))[::7]
    gone = {s for i in dead for s in at if x.left[i] >= s and x.right[i] <= s + 35}
    assert set(np.flatnonzero(x.without(dead, alive, 35))) == set(at) - gone
    if levels > 3:  # symbols grow
        assert np.diff(np.append(x.start, len(words))).mean() > 2


def test_only_shared_symbols_reveal_repeats(spark, corpus, monkeypatch):
    df, _ = corpus
    lost = lambda: sum(r.n_removed for r in substring.remove_repeats(df.dropDuplicates(["text"])).collect())
    some = lost()
    monkeypatch.setattr(substring, "shared_names", lambda state, reps: state.select("h1", "h2", F.array().cast("array<long>").alias("shared")).transform(lambda d: common.materialize(d, "none")))
    assert some > 100 and lost() < some  # windows without an interior symbol alone are left


def vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16)).astype(np.float32)
    rows = []
    for i, v in enumerate(base):
        rows.append((v.tolist(), i % 3))
        for _ in range(i % 4):
            rows.append(((v + rng.normal(scale=0.05 + 0.02 * (i % 5), size=16)).astype(np.float32).tolist(), i % 3))
    rows += [(base[0].tolist(), 0)] * 7 + [(base[0].tolist(), 1), ((2 * base[0]).tolist(), 0)]
    rows += [((base[5] + rng.normal(scale=0.03, size=16)).astype(np.float32).tolist(), 2) for _ in range(60)]
    rows += [(None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([None] * 16, 0), ([float("inf")] + [0.0] * 15, 0), (base[0].tolist(), None), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, e, y, "x") for i, e, y in rows], "vec_id long, embedding array<float>, label int, node string"), rows


@pytest.mark.parametrize("block", [8, 512])
def test_embedding_dedup(spark, block):
    df, rows = vectors(spark)
    fine = [(i, np.array(e, np.float32).astype(float), y) for i, e, y in rows if e is not None and y is not None and None not in e and np.isfinite(e).all() and any(e)]
    links = [(i, j) for i, a, x in fine for j, b, y in fine if i < j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    comp = union_find([r[0] for r in rows], links)
    n = Counter(x for p in links for x in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, block=block).collect()}
    assert len(got) == len(rows)
    found, all_ = sum(v[0] for v in got.values()), 2 * len(links)
    assert 0.98 * all_ <= found <= all_ and all_ > 3000  # recall against brute force, and no false link
    assert all(got[i][0] <= n[i] for i in got)
    if found == all_:
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in comp}


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    a, b = (embdedup.bucket_codes(v) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * z))
    hit = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert hit.mean() > 0.99


def test_embedding_empty(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embdedup.near_duplicates(e).count() == 0
