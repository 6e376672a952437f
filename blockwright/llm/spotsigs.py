"""Document fingerprints by spot signatures, with built-in functions only.

A spot signature is a common word (an antecedent such as "the" or "der") and the chain of content words that follows it,
other common words skipped. The set of a text's signatures, hashed, is its fingerprint: templates and navigation hold
few antecedents and hardly show, running text does. The start of the text counts as an antecedent too, so short texts
have a signature; a text of common words alone has itself as its only one. Tables, junk and texts in languages without
antecedents would have that one only, whatever their length, so one content word in ANCHOR_SHARE, chosen by its hash
alone, is an anchor as well: it starts a chain with the content words after it, anywhere in any text.

``spot_matches`` finds similar texts in a corpus: sets are dealt by their length, since sets of very different length
cannot be similar, compared only where they share one of their rarest signatures (as many as the similarity demands),
and pruned by length again before the exact Jaccard similarity.

Defined cases: a null text counts as empty; the empty text has an empty set; two empty sets are alike (1), an empty and
another set are not (0); equal texts have equal sets whatever their ids; rows equal in id and text are one document in
the order of ``op9``; null ids come last there; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwright.llm._store import stored, table

#: Common words of English, German, French and Spanish that start a chain, and those that chains skip as well.
ANTECEDENTS = "the a of is was that der die das und ist le les des est et el los es y la de que".split()
SKIPPED = (
    "an and are as at be been but by for from had has have he his i if in it its not on or she so than their them then there these they this to we were what when which who will with you "
    "als auch auf aus bei den dem ein eine einen er es für im in mit nicht sich sie so von vor wie zu zum zur "
    "au aux avec ce ces dans du elle en il je ne nous on ou par pas plus pour qui sa se ses son sur un une vous "
    "al con del las lo más no o para pero por se sin su sus un una"
).split()
CHAIN = 2
#: One content word in so many is an anchor.
ANCHOR_SHARE = 8
_START, _ANCHOR = "\x02", "\x03"
_SEPARATORS = r"[\s\p{Punct}]++"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``out``, the sorted set of hashed spot signatures of the column ``text``, as array<int>.

    Words are split once. With skipped words gone, the k-th antecedent, at place i, stands after i - k content words, so
    its chain is a slice of the array of content words: every step is one pass over an array. The steps are columns of
    their own, since each is read more than once.
    """
    antecedents = sorted(set(ANTECEDENTS))
    skipped = ["", *sorted(set(SKIPPED) - set(ANTECEDENTS))]
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", F.filter(F.split(low, _SEPARATORS), lambda w: ~w.isin(*skipped)))
    df = df.withColumn("_content", F.filter("_words", lambda w: ~w.isin(*antecedents)))
    df = df.withColumn("_at", F.filter(F.transform("_words", lambda w, i: F.when(w.isin(*antecedents), i)), lambda i: i.isNotNull()))
    words, content = F.col("_words"), F.col("_content")
    link = lambda first: [F.get(content, first + c) for c in range(chain)]
    spots = F.transform("_at", lambda i, k: F.when(i - k < F.size(content), F.hash(F.get(words, i), *link(i - k))))
    start = F.when(F.size(content) > 0, F.array(F.hash(F.lit(_START), *link(F.lit(0))))).when(low == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(low)))
    chosen = F.transform("_content", lambda w, c: F.when(F.xxhash64(w).bitwiseAND(ANCHOR_SHARE - 1) == 0, F.hash(F.lit(_ANCHOR), w, *link(c + 1))))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.array_compact(F.concat(start, spots, chosen)))))
    return df.drop("_words", "_content", "_at")


def fingerprint(sigs: Column) -> Column:
    return F.md5(F.array_join(F.transform(sigs, lambda s: s.cast("string")), ","))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing where their lengths alone rule ``least`` out."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(longer == 0, F.lit(1.0)).when((shorter == 0) | (shorter < least * longer), F.lit(0.0)).otherwise(exact).cast("double")


def spot_matches(docs: DataFrame, least: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """Pairs (a, b, similarity) of fingerprints with similarity >= ``least``, a < b; membership is the fingerprint of ``with_signatures``."""
    # Written before anything filters on the sets: a filter pushed below them would compute them inside its own lambdas.
    sets = with_signatures(docs.select("text"), "text", "sigs", chain).select(fingerprint(F.col("sigs")).alias("fp"), "sigs")
    sets = stored(sets.dropDuplicates(["fp"]), "spot-sets").where("size(sigs) > 0")
    each = sets.select("fp", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # A set needs to share one of its (1 - least) rarest signatures, plus one, with any set similar to it. The place
    # counts signatures that no other set holds as well: they are the rarest of all.
    ranked = each.join(rare, "sig", "left").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("s"))
    first = ranked.select("fp", "n", F.explode(F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)).alias("s")).where("s.df > 1").select("fp", "n", F.col("s.sig").alias("sig"))
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")
    one = first.select(F.col("fp").alias("a"), F.col("n").alias("na"), "sig", band(F.col("n")).alias("band"))
    two = first.select(F.col("fp").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(band(F.col("n")) - 1, band(F.col("n")), band(F.col("n")) + 1)).alias("band"))
    pairs = one.join(two, ["sig", "band"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least)).select("a", "b").distinct()
    x, y = sets.select(F.col("fp").alias("a"), F.col("sigs").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("sigs").alias("sb"))
    scored = pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def succession(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_chars, next_id, next_hash): each distinct document and the next one by descending id, the first after the last.

    Ids alone are range-sorted; neighbours across a border come from one row per partition.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    narrow = docs.select("doc_id", "hash", "n_chars").distinct()
    ranged = stored(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "succession")
    inside = Window.partitionBy("part").orderBy(*order)
    here = F.struct("doc_id", "hash")
    led = ranged.withColumn("next", F.lead(here).over(inside)).withColumn("place", F.row_number().over(inside))
    firsts = led.where("place = 1").select("part", here.alias("first"))
    along = Window.orderBy("part")  # a row per partition
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = stored(firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after")), "succession-parts")
    out = led.join(F.broadcast(after), "part").withColumn("next", F.coalesce("next", "after"))  # bounded: one row per partition
    return out.select("doc_id", "hash", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.hash").alias("next_hash"))


def op9_spotsigs(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("hash", F.xxhash64("text"))
    follows = stored(succession(docs.select("doc_id", "hash", F.length("text").alias("n_chars"))), "next-documents")
    # Each text goes to its predecessor as far as the edit needs it, and as a set.
    back = follows.select(F.col("next_id").alias("_id"), F.col("next_hash").alias("_hash"), F.col("doc_id").alias("to_id"), F.col("hash").alias("to_hash"), F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    sent = docs.join(back, docs["doc_id"].eqNullSafe(back["_id"]) & (docs["hash"] == back["_hash"]))
    sent = with_signatures(sent.select("to_id", "to_hash", "text", F.expr("left(text, take)").alias("head")), "text", "next_sigs").drop("text")
    sent = sent.groupBy("to_id", "to_hash").agg(F.first("head").alias("head"), F.first("next_sigs").alias("next_sigs"))
    both = docs.join(sent, docs["doc_id"].eqNullSafe(sent["to_id"]) & (docs["hash"] == sent["to_hash"]))
    both = both.withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "head"))
    both = with_signatures(with_signatures(both, "text", "sigs"), "edited", "edited_sigs").withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
