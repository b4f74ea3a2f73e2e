import os
import random

import pytest

from loomline.llm import tokens

FILES = [f"/opt/tokenizers/{n}" for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.mark.skipif(not all(map(os.path.exists, FILES)), reason="no tokenizer files")
def test_counts(spark):
    texts = ["two words", "", None, "<|endoftext|> is ordinary", "naïve – 123", "word " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {f: [r[0] for r in df.select("i", tokens.token_count("text", f).alias("n")).orderBy("i").select("n").collect()] for f in FILES}
    assert got[FILES[0]] == got[FILES[1]]
    assert got[FILES[0]][:3] == [2, 0, None] and all(x[3] > 2 for x in got.values())


def test_cutting_changes_no_count():
    r = random.Random(1)
    text = "".join(r.choice(["word", " word", "  ", "12", ",", "\n", " é"]) for _ in range(3000))
    count = tokens._counter(FILES[0], open(FILES[0], "rb").read()) if os.path.exists(FILES[0]) else len
    parts = tokens.cut(text, 100)
    assert "".join(parts) == text and len(parts) > 20
    assert sum(map(count, parts)) == count(text)
