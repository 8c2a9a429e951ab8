"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot starts at every common word (an anchor) and chains the next content words after it, so that boilerplate
without running text leaves few marks.  A document's fingerprint is its set of distinct spots.  Sets are
compared by their Jaccard likeness; two sets can only reach a likeness t if the smaller holds at least t times
as many spots as the larger, which places them in the same or in neighbouring length partitions and prunes the rest.

Defined cases: a null text is an empty text; a text without a single spot is marked by its words in order, or, if it
has none, by the text itself; an empty text has an empty set, and two empty sets are alike (1.0).  Repeated rows
and equal texts get equal fingerprints.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktape.llm.tables import text_of, written

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which will with "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui se sur un une "
    "auf aus bei das dem den der die ein eine einer es für ist mit nicht sich sie und von war wie zu zum "
    "al como con del el esta los las lo más no para pero por su sus una y"
).split()
CHAIN = 2
REACH = 8
#: Rows of a bucket of neighbours in document order, and the most buckets that are made.
BUCKET_ROWS, BUCKETS = 512, 4096


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spots_of(text: Column, chain: int = CHAIN, reach: int = REACH, anchors: list[str] = ANCHORS) -> Column:
    """The sorted distinct spots of a text: anchor, then the first ``chain`` content words of the next ``reach`` words."""

    def marked(words: Column) -> Column:
        content = lambda i: F.slice(
            F.filter(F.slice(words, i + 1, reach), lambda w: ~w.isin(anchors)), 1, chain
        )
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.element_at(words, i).isin(anchors))
        full = F.filter(F.transform(at, lambda i: F.concat(F.array(F.element_at(words, i)), content(i))), lambda s: F.size(s) == chain + 1)
        return F.array_sort(F.array_distinct(F.transform(full, lambda s: F.array_join(s, " "))))

    def or_whole(found: Column, words: Column) -> Column:
        whole = F.when(F.size(words) > 0, F.concat(F.lit("= "), F.array_join(words, " "))).otherwise(F.concat(F.lit("=="), text))
        return F.when(F.size(found) > 0, found).when(F.length(text) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))

    # transform over a one-element array binds a name, so the words are cut once per text
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    safe = lambda words: F.when(F.size(words) > 0, marked(words)).otherwise(F.array().cast("array<string>"))
    return once(words_of(text), lambda words: once(safe(words), lambda found: or_whole(found, words)))


def fingerprint_of(spots: Column) -> Column:
    """SHA-256 of the set of spots."""
    return F.sha2(F.array_join(spots, "\n"), 256)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; pairs whose lengths rule out ``least`` are not compared and come out as 0."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    value = shared.cast("double") / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, 1.0).when(small.cast("double") / large < least, 0.0).otherwise(value)


def length_partition(spots: Column, least: float) -> Column:
    """Partitions of set lengths whose bounds grow by 1 / ``least``: sets that alike are at most one partition apart."""
    return F.when(F.size(spots) == 0, -1).otherwise(F.floor(F.log(F.size(spots).cast("double")) / math.log(1 / least) + 1e-9).cast("int"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, its spots and its fingerprint."""
    spots = docs.select(F.col(key), spots_of(text_of(text)).alias("spots"))
    return spots.select(key, "spots", fingerprint_of(F.col("spots")).alias("fingerprint"))


def search(queries: DataFrame, docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of fingerprints, one of a query and one of a document, that are alike by at least ``least``, with their likeness.

    Rows with equal fingerprints are one representative; ``fingerprints`` tells which rows a fingerprint stands for.  Two sets
    that reach ``least`` share one of the first (1 - least) * n + 1 spots in order of rarity, so only those are probed, inside
    equal or neighbouring length partitions, and what meets is compared by pruned Jaccard.
    """
    pick = lambda df: df.select("fingerprint", "spots").dropDuplicates(["fingerprint"])
    sets = written(pick(fingerprints(docs, key, text)), "spots")
    asked = written(pick(fingerprints(queries, key, text)), "spots")
    every = pick(sets.unionByName(asked))
    each = every.select("fingerprint", F.explode("spots").alias("spot"))
    seen = each.groupBy("spot").agg(F.count("*").alias("n"))
    ranked = each.join(seen, "spot").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("n", "spot"))).alias("by_rarity"))
    length = F.size("by_rarity")
    ahead = (length - F.ceil(length * least - 1e-9) + 1).cast("int")
    probes = written(
        ranked.withColumn("part", length_partition(F.col("by_rarity"), least))
        .select("fingerprint", "part", F.explode(F.slice("by_rarity", F.lit(1), ahead)).alias("probe"))
        .select("fingerprint", "part", "probe.spot"),
        "probes",
    )
    query = probes.join(asked.select("fingerprint"), "fingerprint").select("spot", F.col("fingerprint").alias("query"), F.col("part").alias("query_part"))
    found = probes.join(sets.select("fingerprint"), "fingerprint")
    pairs = (
        query.join(found, "spot")
        .where((F.abs(F.col("part") - F.col("query_part")) <= 1) & (F.col("query") != F.col("fingerprint")))
        .select("query", "fingerprint").distinct()
    )
    of_query = asked.select(F.col("fingerprint").alias("query"), F.col("spots").alias("query_spots"))
    near = pairs.join(of_query, "query").join(sets, "fingerprint")
    scored = near.select("query", "fingerprint", likeness(F.col("query_spots"), F.col("spots"), least).alias("likeness"))
    same = asked.join(sets.select("fingerprint"), "fingerprint").select(F.col("fingerprint").alias("query"), "fingerprint", F.lit(1.0).alias("likeness"))
    return scored.where(F.col("likeness") >= least).unionByName(same)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as many characters (or all) of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = BUCKET_ROWS, most: int = BUCKETS) -> DataFrame:
    """Key, text and spots of every row, with ``next_text`` and ``next_spots`` of the row that follows in ascending key.

    Null keys come first, ties in order of their texts; the last row is followed by the first.  Rows are cut into ranges
    of the key at measured quantiles, and each range's first row is sent to the range before it as well, so no window
    ever holds more than one range and the texts travel once.
    """
    docs = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    count, last, points = docs.agg(
        F.count("*"), F.max("key"), F.percentile_approx("key", [i / most for i in range(1, most)], 8 * most)
    ).first()
    parts = min(most, -(-count // rows))
    cuts = sorted({points[i * most // parts - 1] for i in range(1, parts)}) if points else []
    # every point is a key of the range that it ends, so only the range after the last point can be empty
    ranges = len(cuts) + (not cuts or last > cuts[-1])
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    place = F.when(F.col("key").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda p: p < F.col("key"))))
    cut = docs.withColumn("range", place)
    first = F.min(F.struct(F.col("key").isNotNull().alias("known"), "key", "text")).alias("first")
    guests = cut.groupBy("range").agg(first).select(
        "first.key", "first.text", ((F.col("range") + ranges - 1) % ranges).alias("range"), F.lit(True).alias("guest")
    )
    dealt = cut.withColumn("guest", F.lit(False)).unionByName(guests).repartition("range")
    window = Window.partitionBy("range").orderBy("guest", F.col("key").asc_nulls_first(), "text")
    both = dealt.withColumn("spots", spots_of(F.col("text"))).select(
        "*", F.lead("text").over(window).alias("next_text"), F.lead("spots").over(window).alias("next_spots")
    )
    return both.where("not guest").select(F.col("key").alias(key), "text", "spots", "next_text", "next_spots")


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How well the fingerprints tell an edited text from the next document, for every document."""
    near = beside_next(docs, key, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    marked = near.withColumn("edited_spots", spots_of(F.col("edited")))
    return marked.select(
        key,
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_of(F.col("spots")).alias("fingerprint"),
        fingerprint_of(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("long").alias("n_spots"),
    )
