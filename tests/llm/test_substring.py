import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockwright.llm import substring
from blockwright.llm._words import slices


def plain(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "width"), [(35, 1 << 20), (35, 1 << 11), (7, 1 << 11), (35, 1 << 26)])
def test_brute_force(docs, rows, length, width):
    out = substring.substring_deduped(docs, length, width, spaced=False).collect()
    want = plain([r[1] for r in rows], length)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in out) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert any(w[1] for w in want)


def test_spacing(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a  b\n{passage}\n\nc\td "), (2, f"x {passage}"), (3, " as\n is ")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring.substring_deduped(docs).collect()}
    assert out == {1: "a  b\nc\td ", 2: "x ", 3: " as\n is "}


def test_landmarks_agree():
    rng = random.Random(1)
    passage = " ".join(str(rng.random()) for _ in range(35))
    texts = [f"{' '.join('p' * rng.randint(1, 3) for _ in range(k))} {passage} tail" for k in range(20)]
    marks = set()
    for _, _, words in slices(pa.array(texts)):
        first, mark, h = substring.landmarks(words)
        for k in range(20):
            at = words.first[k] + k  # the passage's window
            marks.add(int(h[mark[list(first).index(at)]]))
    assert len(marks) == 1


def test_edges(empty, docs, rows):
    assert substring.substring_deduped(empty).count() == 0
    more = docs.withColumn("key", F.lit("x")).withColumn("once", F.lit("z")).withColumn("a b.c", F.lit("w"))
    out = substring.substring_deduped(more.withColumn("n_words", F.lit("y")))
    assert out.columns == [*more.columns, "n_words", "n_removed"] and out.where("key = 'x' and once = 'z' and `a b.c` = 'w'").count() == len(rows)
    assert out.count() == len(rows) and out.where("text is null").count() == sum(r[1] is None for r in rows)
