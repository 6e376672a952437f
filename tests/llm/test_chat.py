import random

from pyspark.sql import functions as F

from blockwright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Where is the station please?\nI am lost."), (1, 1, "assistant", "> Where is the station please?\nNext to the bank."), (1, 2, "user", "Another question about trains"),
    (1, 3, "user", "> > Where is the station please?\n> Next to the bank.\nThanks a lot!"), (1, 4, "assistant", "> Another Question, about TRAINS\nAsk away"),
    (2, 0, "user", "> Next to the bank.\nwhich bank is it?"), (2, 1, "assistant", ">> which bank\nunrelated text here"), (2, 2, "user", "> which bank is it?\n>\nThe blue one"),
]


def test_reply_order(spark):
    out = chat.formatted(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    order = {c: [(r["conv_id"], r["turn"], r["depth"]) for r in sorted(out, key=lambda r: r["position"]) if r["conversation"] == c] for c in (1, 2)}
    assert order == {1: [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 2, 3), (1, 3, 2), (1, 2, 0), (1, 4, 1)], 2: [(2, 1, 0)]}
    text = {(r["conv_id"], r["turn"]): r["formatted"] for r in out}
    assert text[1, 3] == "<|user|>\nThanks a lot!\n" and ">" not in text[2, 1].replace("|>", "")
    reply = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in out}
    assert reply[1, 3] == (1, 1) and reply[2, 0] == (1, 1) and reply[1, 0] == (None, None)


def test_random_threads_against_plain(spark):
    """Each message may quote one earlier message of its conversation in full; position is a depth-first walk."""
    rng = random.Random(6)
    rows, parents = [], {}
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 25)):
            own = f"message {rng.random()} of conversation {c}"
            p = rng.randrange(t) if t and rng.random() < 0.6 else None
            parents[c, t] = p
            rows.append((c, t, "user", own if p is None else "> " + said[p].upper() + "\n" + own))
            said.append(own)
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()

    def path(c, t):
        p = parents[c, t]
        return [t] if p is None else [*path(c, p), t]

    for c in range(12):
        got = [r["turn"] for r in sorted(out, key=lambda r: r["position"]) if r["conversation"] == c]
        assert got == sorted((t for k, t in parents if k == c), key=lambda t: path(c, t))


def test_edges(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, None, "user", "> quoted text here"), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "user", ">" * 50 + " deep\n" * 3)]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA).withColumn("msg", F.lit("x")).withColumn("own", F.lit(2))).collect()
    assert len(out) == 5 and sorted(r["position"] for r in out if r["conversation"] == 1) == [0, 1, 2, 3]
    hot = [(7, i, "user", "hello there my friend" if i % 2 == 0 else "> hello there my friend\nyes") for i in range(400)]
    out = chat.formatted(spark.createDataFrame(hot, SCHEMA)).collect()
    assert sorted(r["position"] for r in out) == list(range(400)) and all(r["reply_turn"] == r["turn"] - 1 for r in out if r["turn"] % 2)


def test_parts_of_quotations(spark):
    """A paragraph of a quoting reply, some lines or paragraphs of an original, and a short text of the conversation are found."""
    rows = [
        (1, 0, "user", "how do trains run"), (1, 1, "assistant", "> how do trains run\nfirst paragraph line\nsecond line of it\n\nanother paragraph here"),
        (1, 2, "user", "> first paragraph line\n> second line of it\nwhy?"), (1, 3, "user", "line number one\nline number two\nline number three\n\nnext part\n\nlast part"),
        (1, 4, "assistant", "> line number one\n> line number two\nsure"), (1, 5, "assistant", "> next part\n>\n> last part\nfine"), (1, 6, "user", "> sure\ngood"),
        (2, 0, "user", "> sure\nshort ones stay in their conversation"),
    ]
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    reply = {(r["conv_id"], r["turn"]): r["reply_turn"] for r in out}
    assert reply == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 3, (1, 5): 3, (1, 6): 4, (2, 0): None}
