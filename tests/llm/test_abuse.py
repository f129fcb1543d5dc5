import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from corvane.llm import abuse as a
from tests.conftest import rows

NICE = ["The pacing is warm and the soundtrack modest.", "Viewers mostly praised the careful framing.", "The booklet names an editor, yet the index does not.", "字幕は丁寧で衣装は素朴だ。", "大部分场景在港口布景拍摄。"]
NASTY = ["You useless stupid parasite, get lost.", "Nobody would miss you if you vanished tomorrow.", "お前みたいなバカは消えろ。", "你这个没用的蠢货滚出去。"]
HARMLESS = ["The character calls himself a stupid old fool and laughs.", "A parasite is the subject of the documentary."]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    docs, bad = [], set()
    for i in range(n):
        parts = rng.choices(NICE, k=5)
        if i % 8 == 0:
            parts.insert(rng.randrange(5), rng.choice(NASTY))
            bad.add(i)
        elif i % 8 == 1:
            parts.insert(rng.randrange(5), rng.choice(HARMLESS))
        docs.append((i, " ".join(parts) + f" no {i}"))
    return docs, bad


def scored(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, _t string, abusive int") if docs and len(docs[0]) == 5 else spark.createDataFrame(docs, "doc_id long, text string")
    return a.score_documents(d, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, abusive int, by string"), "doc_id", "abusive")


def test_held_out_accuracy(spark):
    docs, bad = corpus()
    labels = [(i, int(i in bad), "x") for i, _ in docs if i < 200]
    labels += [(3, 1, "wrong"), (8, 0, "x"), (16, 0, "y"), (None, 1, "x"), (24, None, "x")]
    got = {r["doc_id"] for r in scored(spark, docs, labels).where("abusive").collect()}
    held = set(range(200, 400))
    assert len(got & held & bad) >= 0.95 * len(bad & held) and not (got & held) - bad


def test_disguises(spark):
    docs, bad = corpus()
    docs += [(1001, "Nice. You u-s-e-l-e-s-s stup1d p.a.r.a.s.i.t.e, get lost."), (1002, "你这个没·用·的蠢​货滚/出/去。"), (1003, "Nоbоdy wоuld miss yоu if yоu vanishеd tоmоrrоw."), (1004, "ＮＯＢＯＤＹ ＷＯＵＬＤ ＭＩＳＳ ＹＯＵ ＩＦ ＹＯＵ ＶＡＮＩＳＨＥＤ")]
    got = {r["doc_id"] for r in scored(spark, docs, [(i, int(i in bad), "x") for i in range(300)]).where("abusive").collect()}
    assert {1001, 1002, 1003, 1004} <= got


def test_odd_rows_and_clashing_columns(spark):
    docs, bad = corpus(120)
    docs = [(i, t, "s", "t", 5) for i, t in docs] + [(500, None, "s", "t", 5), (501, "", "s", "t", 5), (502, " \n", "s", "t", 5), (None, "x", "s", "t", 5), (503, NICE[0] * 3_000, "s", "t", 5), (503, NICE[0], "s", "t", 5)]
    got = scored(spark, docs, [(i, int(i in bad), "x") for i in range(120)] * 2)
    assert got.count() == 125 and got.where("doc_id >= 500 and abusive").count() == 0


def test_no_labels_and_empty_table(spark):
    docs, _ = corpus(20)
    assert scored(spark, docs, []).where("abusive").count() == 0
    assert scored(spark, docs, [(1, 0, "x")]).where("abusive").count() == 0
    assert rows(scored(spark, [], [(1, 1, "x")])) == []


@given(st.lists(st.integers(-5, 5), max_size=25))
def test_best_segment_against_brute_force(scores):
    s = np.array(scores, np.float32)
    best, begin, end = a.best_segments(s, np.zeros(len(s), np.int64), 1)
    want = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert best[0] == want
    if want:
        assert sum(scores[begin[0] : end[0]]) == want


@given(st.lists(st.integers(-5, 5), max_size=25))
def test_segments_are_disjoint_and_hold_the_best(scores):
    found = a.all_segments(np.array(scores, np.float32), 1)
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert all(sum(scores[b:e]) == x for b, e, x in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert max([0, *(x for _, _, x in found)]) == best
