import random
from collections import Counter

import pytest

from blockwright.operators import dictionary
from blockwright.sources.dictionaries import DictionaryStore


def test_store(spark, tmp_path):
    store = DictionaryStore(spark, str(tmp_path / "dicts"))
    assert store.all().count() == 0
    a, b = store.put(b"one dictionary"), store.put(b"another", "file")
    assert store.put(b"one dictionary") == a != b
    assert store.get(a) == b"one dictionary" and store.get("17") is None
    assert {(r["dict_id"], r["scope"]) for r in store.all().collect()} == {(a, "external"), (b, "file")}
    assert store.remove(a) and not store.remove(a) and store.all().count() == 1
    for bad in (b"", b"x" * 65536):
        with pytest.raises(ValueError):
            store.put(bad)


def test_greedy_over_all_segments(spark):
    """Few candidates a round give the dictionary of the plain greedy over every segment."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(30)]
    texts = ["".join(rng.choice(words[:4] if i < 30 else words) for _ in range(4)) for i in range(90)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    grams = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    df = Counter(g for t in texts for g in grams(t))
    seen, room, want = set(), 600, []
    while room > 0:
        gain, pick = min((-sum(df[g] for g in grams(t) - seen if df[g] > 1), t) for t in texts)
        if not gain:
            break
        seen |= grams(pick)
        want.append(pick.encode()[:room])
        room -= len(want[-1])
    for candidates in (3, 2000):
        assert dictionary.train(frame, "id", "text", size=600, candidates=candidates) == b"".join(reversed(want))


def test_tasks_hand_over_few_segments(spark):
    """What tasks send to the driver follows ``candidates``, not their number; the dictionary is the same."""
    rng = random.Random(5)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(40)]
    texts = ["".join(rng.choice(shared) for _ in range(4)) for _ in range(3000)]
    context = spark.sparkContext
    sent = []

    def stages():
        java = context._jvm
        return {s.stageId(): s.resultSize() for s in java.scala.jdk.javaapi.CollectionConverters.asJava(context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(java.double, 0), java.java.util.ArrayList()))}

    def trained(tasks):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        before = set(stages())
        out = dictionary.train(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", size=240, candidates=300)
        sent.append(sum(n for k, n in stages().items() if k not in before))
        return out

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert trained("1") == trained("12")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sent[1] < 3 * sent[0]
