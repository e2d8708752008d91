"""I-Match fingerprints over an inverse-document-frequency band, with DataFrame functions alone.

A text's terms are its distinct words whose document frequency over the whole table lies within a band. The lexicon is
split at random into LANES sub-lexicons and each of these is thinned at random, level by level, by half; a text uses the level
that leaves about one term for each lane, and the next. For each lane and level its distinct terms are sorted and hashed.
The likeness of two texts is the share of lanes, among those with terms, whose hashes agree at a level that both have.

Every term of the band has at least `least_share` of the documents, so the lexicon holds at most (mean distinct words of a
document) / least_share terms, however many documents there are; its size is counted, and beyond `most_terms` it is
joined by a shuffle and not by a broadcast.

The next document is found by cutting the ids at quantiles: documents of a bucket meet in one task, sorted; the last of a
bucket gets the first of the following bucket by a small join.

Defined cases: null text is empty; a text without terms in the band is identified by all its distinct words (an empty text by
none), and is like another, 1, only if these are the same, else 0; null ids sort last, by a hash of their texts; repeated rows follow each
other; a table of one row has itself as next; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .words import let, words_of

LANES = 32
#: The band: document frequency as a share of all documents, which is the exponent of minus the inverse document frequency.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
MOST_TERMS = 2_000_000
BUCKET_ROWS, MOST_BUCKETS = 500, 16_384
TERM = -4  # the two lowest bits of a term's hash say which text it is from


def term_hashes(text: Column) -> Column:
    """Distinct words as 64-bit hashes with the two lowest bits clear."""
    return F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w).bitwiseAND(F.lit(TERM).cast("long"))))


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """(term) of the band, over all documents; a term of one document is never in it."""
    n = docs.count()
    frequency = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term")).groupBy("term").count()
    return frequency.where((F.col("count") >= max(2, least_share * n)) & (F.col("count") <= most_share * n)).select("term")


def _rank_in(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value, in two steps of about the square root of their number."""
    width = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[width - 1 :: width], cuts
    array = lambda xs: F.expr(f"CAST(array({','.join(f'{x}L' for x in xs)}) AS array<bigint>)")
    full = F.size(F.filter(array(coarse), lambda c: c <= value)) * width
    return let(full, lambda k: k + F.size(F.filter(F.slice(array(fine), k + 1, width), lambda c: c <= value)))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, text) with bucket, place (in its bucket), last (of its bucket) and next_text, that of the next document
    in descending order of ids; after the last comes the first. Hash-partitioned by bucket."""
    n, named = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    buckets = max(1, min(MOST_BUCKETS, named // bucket_rows))
    cuts: list[int] = []
    if buckets > 1:
        cuts = docs.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        cuts = sorted(set(cuts))  # at most MOST_BUCKETS ids
    tie = F.xxhash64("text")
    # Rows without an id come last, in the order of their hashes, which deals them over buckets below zero.
    nameless = max(1, min(MOST_BUCKETS, (n - named) // bucket_rows))
    below = -1 - F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * nameless), F.lit(nameless - 1)).cast("int")
    spread = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), below).otherwise(_rank_in(cuts, F.col("doc_id")) if cuts else F.lit(0)).cast("int"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), tie)
    placed = spread.repartition("bucket").select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"), F.lead(F.lit(True), 1, False).over(order).alias("_more"))
    # The last document of each bucket is followed by the first of the next bucket down; only the buckets' numbers, at most
    # twice MOST_BUCKETS, meet in one task.
    down = Window.orderBy(F.col("bucket").desc())
    followed = spread.select("bucket").distinct().select("bucket", F.lead("bucket").over(down).alias("_next"), F.max("bucket").over(Window.partitionBy()).alias("_top"))
    first = F.min_by("text", F.struct(F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), tie))  # the complement turns the order round
    firsts = spread.groupBy("bucket").agg(first.alias("after")).withColumnRenamed("bucket", "_next")
    heads = followed.select("bucket", F.coalesce("_next", "_top").alias("_next")).join(firsts, "_next").select("bucket", "after")
    return placed.join(heads, "bucket", "left").select("doc_id", "text", "bucket", "place", (~F.col("_more")).alias("last"), F.when(F.col("_more"), F.col("next_text")).otherwise(F.col("after")).alias("next_text"))


def _lanes(terms: Column, level: Column) -> Column:
    """array<bigint> of LANES hashes, null for a lane without terms."""
    kept = F.filter(terms, lambda t: F.shiftrightunsigned(t, 40).bitwiseAND(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), level).cast("long") - 1) == 0)
    lane = lambda t: F.shiftrightunsigned(t, 8).bitwiseAND(F.lit(LANES - 1).cast("long"))
    return let(
        F.array_sort(kept),
        lambda all_terms: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: let(F.filter(all_terms, lambda t: lane(t) == k), lambda own: F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFF).cast("long"))))),
    )


def signature(terms: Column, whole: Column) -> Column:
    """struct(level, fine, coarse, whole): terms are the band's terms of a text, whole identifies all its words."""
    level = F.greatest(F.ceil(F.log2(F.greatest(F.size(terms), F.lit(1)) / F.lit(float(LANES)))), F.lit(0)).cast("int")
    return let(F.struct(terms.alias("t"), level.alias("level")), lambda s: F.struct(s["level"].alias("level"), _lanes(s["t"], s["level"]).alias("fine"), _lanes(s["t"], s["level"] + 1).alias("coarse"), F.when(F.size(s["t"]) == 0, whole).alias("whole")))


def text_form(s: Column) -> Column:
    """A signature as text: level, then four hexadecimal digits a lane; or "w" and the hash of all words."""
    lanes = lambda a: F.array_join(F.transform(a, lambda h: F.when(h.isNull(), F.lit("....")).otherwise(F.lower(F.lpad(F.hex(h), 4, "0")))), "")
    return F.when(s["whole"].isNotNull(), F.concat(F.lit("w"), F.lower(F.lpad(F.hex(s["whole"]), 16, "0")))).otherwise(F.concat(s["level"].cast("string"), F.lit(":"), lanes(s["fine"]), F.lit(":"), lanes(s["coarse"])))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal signatures."""
    def share(x: Column, y: Column) -> Column:
        both = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"].isNotNull() | z["y"].isNotNull())
        return let(both, lambda z: F.when(F.size(z) == 0, 0.0).otherwise(F.size(F.filter(z, lambda p: p["x"] == p["y"])) / F.size(z)))

    apart = a["level"] - b["level"]
    by_lane = F.when(apart == 0, share(a["fine"], b["fine"])).when(apart == -1, share(a["coarse"], b["fine"])).when(apart == 1, share(a["fine"], b["coarse"])).otherwise(0.0)
    whole = a["whole"].isNotNull() | b["whole"].isNotNull()
    return F.when(whole, F.coalesce((a["whole"] == b["whole"]).cast("double"), F.lit(0.0))).otherwise(F.coalesce(by_lane, F.lit(0.0)))


def fingerprints(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    terms = materialize(lexicon(docs, "text", least_share, most_share), "lexicon").withColumn("known", F.lit(True))
    if terms.count() <= most_terms:
        terms = F.broadcast(terms)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))
    rows = with_next(docs).withColumn("edited", edited)
    sets = rows.select(
        "doc_id", "bucket", "place", "last", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.array(term_hashes(F.col("text")), term_hashes(F.col("edited")), F.when(F.col("last"), term_hashes(F.col("next_text"))).otherwise(F.expr("CAST(array() AS array<bigint>)"))).alias("sets"),
    )
    # All three sets in one array, each term with the number of its text in the two lowest bits.
    tagged = F.flatten(F.transform("sets", lambda s, i: F.transform(s, lambda t: t.bitwiseOR(i.cast("long")))))
    whole = F.transform("sets", lambda s: F.when(F.size(s) > 0, F.xxhash64(F.array_sort(s))).otherwise(F.lit(0).cast("long")))
    info = F.struct("doc_id", "last", "n_chars", "edited_sha256", whole.alias("whole"))
    each = sets.select("bucket", "place", info.alias("info"), F.posexplode_outer(tagged).alias("pos", "x"))
    # What is known of a document goes with its first term alone, and further terms only if the band has them: the rows stay narrow.
    # A document without words has a row, too, with a key of its own, as null would be one key for all of them.
    first = F.coalesce("pos", F.lit(0)) == 0
    each = each.select("bucket", "place", "x", first.alias("first"), F.when(first, F.col("info")).alias("info"), F.coalesce(F.col("x").bitwiseAND(F.lit(TERM).cast("long")), F.xxhash64("bucket", "place")).alias("term"))
    each = each.join(terms, "term", "left").where(F.col("first") | F.col("known"))
    of = lambda i: F.collect_list(F.when(F.col("known") & (F.col("x").bitwiseAND(F.lit(3).cast("long")) == i), F.col("term")))
    by_doc = each.groupBy("bucket", "place").agg(of(0).alias("a"), of(1).alias("b"), of(2).alias("c"), F.first("info", ignorenulls=True).alias("info")).select("bucket", "place", "a", "b", "c", "info.*")
    signed = by_doc.select("bucket", "place", "doc_id", "last", "n_chars", "edited_sha256", signature(F.col("a"), F.col("whole")[0]).alias("s"), signature(F.col("b"), F.col("whole")[1]).alias("e"), F.when(F.col("last"), signature(F.col("c"), F.col("whole")[2])).alias("n"))
    following = F.coalesce("n", F.lead("s").over(Window.partitionBy("bucket").orderBy("place")))
    return signed.withColumn("n", following).select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("s")).alias("fingerprint"), text_form(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"), likeness(F.col("s"), F.col("n")).alias("near_next"),
    )


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
