import random
from pathlib import Path

import pytest

from corvane.llm import tokenize as t
from corvane.llm.tokenize_queries import VOCABULARY_FILE
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not Path(VOCABULARY_FILE).exists(), reason="no vocabulary here")
TEXTS = ["", None, " ", "a" * 1001, "ab" * 333, "<|endoftext|>", "it's  we'll\n\n x　\xa0 \x85y", "日本語と中文、and English 12345.", "\U0001f600‍\U0001f468" * 9, "\x00\x01", "aaa aaaa  aaaaa"]


def randoms():
    rng = random.Random(5)
    pool = [lambda: rng.randint(1, 0x2FF), lambda: rng.randint(0x2000, 0x30FF), lambda: rng.randint(0x4E00, 0x4EFF), lambda: rng.randint(0x1F300, 0x1F6FF), lambda: 32, lambda: 97, lambda: 98]
    return ["".join(chr(rng.choice(pool)()) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_same_ids_as_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(VOCABULARY_FILE)
    theirs.encode_special_tokens = True
    texts = [*TEXTS, *randoms()]
    ids, begin = t.encode_texts(texts, t.Vocabulary(VOCABULARY_FILE))
    for i, e in enumerate(theirs.encode_batch([x or "" for x in texts], add_special_tokens=False)):
        assert ids[begin[i] : begin[i + 1]].tolist() == e.ids


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK_CHARS", 50)
    texts = [*TEXTS, *randoms()[:40]]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts)], "id long, text string, key string")
    back = t.decoder(VOCABULARY_FILE)
    got = {r["id"]: r["ids"] for r in t.encode_corpus(df, "id", "text", VOCABULARY_FILE).collect()}
    assert {i: back(x) for i, x in got.items()} == {i: x or "" for i, x in enumerate(texts)}


def test_repeats_null_keys_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "id long, text string")
    assert rows(t.encode_corpus(df, "id", "text", VOCABULARY_FILE)) == [(1, [64, 275]), (1, [64, 275]), (None, [])]
    assert rows(t.encode_corpus(df.where("id > 5"), "id", "text", VOCABULARY_FILE)) == []


def test_very_long_text():
    ids, begin = t.encode_texts(["xyz " * 200_000], t.Vocabulary(VOCABULARY_FILE))
    assert t.decoder(VOCABULARY_FILE)(ids.tolist()) == "xyz " * 200_000 and begin.tolist() == [0, len(ids)]
