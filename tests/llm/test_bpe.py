import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwright.llm import bpe

TEXTS = [
    "", "hello  world\n\n  x<|endoftext|>y <|endoftext|>", "日本語のテキストと中文漢字混合", "😀😀👍🏽 naïve ʻokina ꟎ x ꟎՘", "a" * 300, "   \t\t\n", "it's they'RE we'll 1234567 ½",
    "http://www.example.com/a_b-c?d=e&f=1234567890", "def f(x):\n    return x**2  # test\n" * 3, "ÃÂ" * 20, "." * 90, "\x00\x7f​﻿", " ".join(f"w{i}ing" for i in range(800)),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_matches_the_library(library):
    coder = bpe.ByteBPE(bpe.default_path())
    rng = np.random.default_rng(1)
    vocabulary = [t.decode("utf-8", "ignore") for t in coder.ids]
    texts = TEXTS + ["".join(rng.choice(vocabulary, 30)) for _ in range(400)]
    for text, packed in zip(texts, coder.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert coder.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_every_sure_character_splits_alike(library):
    coder = bpe.ByteBPE(bpe.default_path())
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or bpe._UNSURE.search(chr(c)) or (0x3400 <= c < 0x9F00 or 0xAC00 <= c < 0xD700 or c > 0x20010) and c % 97:
            continue
        text = f"a{chr(c)}1{chr(c)}! {chr(c)}"
        assert coder.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_dataframe(docs, rows, empty, library, monkeypatch):
    out = bpe.encoded(docs.withColumn("ids", F.lit(1)), bpe.default_path()).collect()
    assert len(out) == len(rows)
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == (r["text"] or "")
    assert bpe.encoded(empty, bpe.default_path()).count() == 0
    bare = bpe.encoded(docs, bpe.default_path(), text=False)
    assert bare.columns == [*(c for c in docs.columns if c != "text"), "n_tokens", "ids", "decoded"] and bare.count() == len(rows)


def test_ascii_splits_alike():
    coder = bpe.ByteBPE(bpe.default_path())
    rng = np.random.default_rng(2)
    for _ in range(2000):
        text = bytes(rng.integers(0, 128, 40, np.uint8)).decode()
        assert coder._split_ascii(text) == coder._split(text)


def test_small_caches(library, monkeypatch):
    for name in ("PAIRS", "CACHE_EDGES", "STEPS"):
        monkeypatch.setattr(bpe, name, 50)
    coder = bpe.ByteBPE(bpe.default_path())
    for text in TEXTS:
        assert np.frombuffer(coder.encode_batch([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
