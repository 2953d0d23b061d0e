"""Decontamination at the stated rate: a tenth of an item's characters, whatever the item's length or script."""

from __future__ import annotations

import random

from caselight.llm import decontam

from .test_filters import edited, semi_global


def test_a_tenth_of_the_characters_by_brute_force():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 5, 6, 7, 8, 9, 12, 14, 20, 28, 40, 60])]
    matcher, near = decontam.Matcher(items), 0
    for i in range(240):
        _, item = items[i % len(items)]
        s = decontam.normal(f"{text(12)} {edited(rng, item, rng.randint(0, len(item) // 8 + 1))} {text(8)}")
        want = {}
        for k, p in items:
            d = semi_global(p, s)
            if 10 * d <= len(p):
                want[k] = d
                near += 10 * d > 0.6 * len(p)
        assert {m[0]: m[1] for m in matcher.find(s.encode())} == want
    assert near > 30  # beyond the sixteenth that was once looked for


def test_three_changed_words_in_forty_are_dropped(spark):
    words = [f"word{i:02d}" for i in range(40)]
    other = [*words]
    for i in (5, 18, 33):
        other[i] = "change"
    han = "机器学习模型的训练数据中不应包含评测题目否则评测结果将失去意义"
    df = spark.createDataFrame([(1, "x y z " + " ".join(other)), (2, "前文" + han.replace("否则", "不然") + "后文"), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, han), (9, "题目")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.matches(df, bench).collect()) == [(1, 7, 18), (2, 8, 2)]
    assert [r.doc_id for r in decontam.decontaminate(df, bench).collect()] == [3]
