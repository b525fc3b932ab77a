import random
from pathlib import Path

import pytest

from tidewell.llm.tokenize import TOKENIZERS, VOCABULARY, codec, encode_texts

PATH = f"{TOKENIZERS}/{VOCABULARY}"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files")


def test_joined_leaves_equal_whole_encoding():
    c = codec(PATH)
    rng = random.Random(3)
    alphabet = "ab c'strellmd 12 3，。，中文字路\n\n  　é́😀-—."
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        n = rng.randint(1, 40)
        assert c.join_all([c.encode(s[i : i + n]) for i in range(0, len(s), n)]).tolist() == c.encode(s).tolist()


def test_giant_run_without_boundary():
    c = codec(PATH)
    s = "a" * 5000
    assert c.join_all([c.encode(s[i : i + 777]) for i in range(0, len(s), 777)]).tolist() == c.encode(s).tolist()


def test_cases(spark):
    long = "Notice 12, 公示内容。" * 500
    rows = [(1, "one two", "x"), (2, "", "x"), (3, None, "x"), (4, " \n", "x"), (5, long, "x"), (5, long, "x"), (None, "t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    c = codec(PATH)
    out = [(r["id"], list(r["ids"])) for r in encode_texts(df, "doc_id", "text", leaf_chars=100).collect()]
    want = [(i, c.encode(t).tolist()) for i, t, _ in rows]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    counts = {(r["id"], r["n_tokens"]) for r in encode_texts(df, "doc_id", "text", leaf_chars=100, counts_only=True).collect()}
    assert counts == {(i, len(x)) for i, x in want}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
