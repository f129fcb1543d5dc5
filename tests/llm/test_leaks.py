import random

import numpy as np
import pytest

from corvane.llm import leaks as lk
from tests.conftest import rows

ITEM = "Because the archivist had counted nine amber lanterns behind the harbour wall, the quiet ferryman repaired a copper turbine before noon and nobody ever asked which of the seven windows faced the frozen orchard that winter."
CHINESE = "因为档案员曾在粮仓清点雾气中的棋盘，剩下的七件涡轮在罢工之后由面包坊的摆渡人编目，却没有人见过灯塔里的手风琴。"
FILLER = "Cover scans of the release show a warm pacing and four stills while viewers mostly praised the modest soundtrack."
WORDS = ITEM.split()


def found(spark, texts, items=((1, ITEM), (2, CHINESE))):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted(rows(lk.leaked_passages(d, "doc_id", "text", i, "item_id", "text").select("doc", "item")))


def test_passages(spark):
    rng = random.Random(1)
    changed = [w if k % 9 != 4 else "certain" for k, w in enumerate(WORDS)]
    shuffled = WORDS[:]
    rng.shuffle(shuffled)
    pieces = [CHINESE[i : i + 5] for i in range(0, len(CHINESE), 5)]
    rng.shuffle(pieces)
    texts = {
        1: f"{FILLER} {ITEM} {FILLER}", 2: ITEM.upper().replace(" ", "\n  "), 3: f"{FILLER} {' '.join(changed)}", 4: f"{FILLER} {' '.join(WORDS[10:24])} {FILLER}", 5: f"{FILLER} {' '.join(WORDS[10:18])} {FILLER}", 6: " ".join(shuffled),
        7: FILLER + CHINESE, 8: "前文。" + CHINESE[5:34] + "后文。", 9: "前文。" + CHINESE[5:17] + "后文。", 10: "".join(pieces), 11: "​".join(CHINESE), 12: ITEM.replace("lanterns", "**lanterns**").replace("copper", "<b>copper</b>"), 13: " ".join(WORDS[:12] + WORDS[13:]), 14: None, 15: "", 16: " \n ",
    }
    assert found(spark, texts) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 2), (8, 2), (11, 2), (12, 1), (13, 1)]


def test_items_of_one_pattern_do_not_share_passages(spark):
    nouns = ["lantern", "barometer", "satchel", "trumpet", "windmill", "compass", "ledger", "sundial"]
    places = ["harbour", "marsh", "chapel", "orchard", "quarry", "tollgate", "cellar", "granary"]
    item = lambda k: f"A hollow {nouns[k]} counted beside the {places[k]} without permission was later weighed by the dented {nouns[-k]} keeper of the {places[-k]} before the flood"
    items = [(k, item(k)) for k in range(1, 8)]
    assert found(spark, {k: f"{FILLER} {item(k)}" for k in range(1, 8)}, items) == [(k, k) for k in range(1, 8)]


def test_empty_tables_repeats_and_very_long_texts(spark):
    assert found(spark, {1: ITEM}, []) == []
    assert found(spark, {}) == []
    long = FILLER * 3_000 + ITEM + FILLER * 3_000
    assert found(spark, {1: long, 2: "word " * 100_000, 3: long}) == [(1, 1), (3, 1)]
    assert found(spark, {1: ITEM}, [(1, ITEM), (5, ITEM), (None, ITEM), (6, None), (7, "")]) == [(1, 1), (1, 5)]


def test_recall_of_random_passages_with_changes(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "ba do fe gi ko lu ma ne po ri".split() for b in "nar tel dim sor vek lin pat rus mol fen".split()]
    items = [(k, " ".join(rng.choices(vocabulary, k=60))) for k in range(40)]
    texts, want = {}, []
    for k, text in items:
        ws = text.split()
        at = rng.randrange(30)
        passage = [w if rng.random() > 0.08 else "changed" for w in ws[at : at + 24]]
        texts[k] = " ".join(rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=40))
        want.append((k, k))
    got = found(spark, texts, items)
    assert len(set(got) & set(want)) >= 38 and not set(got) - set(want)


def test_tokens():
    assert lk.tokens("It's **Ｂｏｌｄ** <i>x-y</i> 日本​語。") == ["its", "bold", "x", "y", "日", "本", "語"]


@pytest.mark.parametrize("drop", [3, 9])
def test_alignment_bridges_left_out_words(drop):

    codes = np.arange(1, 31)
    doc = np.r_[np.full(5, 99), np.delete(codes, drop), np.full(5, 98)].astype(np.int64)
    out = lk.verify([(doc, codes, np.ones(30, np.float32), 5, False)])
    assert out[1][0] >= 26 and out[0][0] >= 27


def test_pairs_without_hope_are_those_that_alignment_rejects():
    rng = np.random.default_rng(5)
    lengths, windows, items = np.array([20, 30, 12, 30, 11]), rng.integers(1, 9000, (5, 46)), np.full((5, 30), -1)
    items[0, :20] = rng.integers(10_000, 20_000, 20)  # nothing in common
    items[1] = windows[1, 8:38]  # all
    items[2, :12] = np.r_[windows[2, 8:19], 0]  # eleven of twelve
    items[3] = np.where(np.arange(30) % 2 == 0, windows[3, 8:38], 30_000)  # every other one
    items[4, :11] = windows[4, 8:19]  # all of too few
    assert lk.hopeful(windows, items, lengths, np.full(5, lk.LEAST_WORDS)).tolist() == [False, True, True, False, False]


def test_a_long_tag_is_no_text():
    assert lk.tokens("a <img title='" + "x " * 400 + "'> b 1 < 2 and 3 > 2") == ["a", "b", "1", "2", "and", "3", "2"]
