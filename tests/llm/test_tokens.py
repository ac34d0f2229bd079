import random

import pytest

from tesserae.llm import tokens

pytest.importorskip("tokenizers")


def _reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_public_library():
    ref, enc = _reference(), tokens.encoder(tokens.TOKENIZERS)
    rng = random.Random(5)
    alphabets = ["ab cd\n\t'", "aeinrst hou", "aé ü漢字́​\U0001f600 '’", " \x1c\x1d\x1f\x85\xa0 \r\n\x00x 　  ", "0123456789²½五 a", "<|endoftext|> 'LL'll"]
    texts = ["", " ", "a" * 3000, "  \n\n x", "<|endoftext|>", "x = {'a': 1}\n" * 50, "é" * 40, "ab" * 700, "﻿abc", "don't we'll I'D"]
    for _ in range(1500):
        a = rng.choice(alphabets)
        texts.append("".join(rng.choice(a) for _ in range(rng.randrange(1, 60))))
    for t in texts:
        assert list(enc.encode(t)) == ref(t), repr(t)
        assert enc.count(t) == len(ref(t))


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (4, "hello world", "z"), (4, "hello world", "z"), (None, "a", "b")], "doc_id long, text string, ids string")
    ref = _reference()
    rows = tokens.encode_column(df, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted([("1", ref("hello world")), ("2", []), ("3", []), ("4", ref("hello world")), ("4", ref("hello world")), ("None", ref("a"))])
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert {(r.doc_id, r.n_tokens) for r in tokens.count_column(df, "doc_id", "text").collect()} == {(1, 2), (2, 0), (3, 0), (4, 2), (None, 1)}
