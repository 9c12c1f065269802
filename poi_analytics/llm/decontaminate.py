"""Benchmark decontamination with built-in functions only.

Finds short test items inside long documents: size-partitioned MinHash sketches of the
items give candidates, exact shingle containment decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poi_analytics.llm.shared import ordered_id, row_key, saved

WORDS = 5
CONTAINMENT = 0.8


def words(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits (combining marks included)."""
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _shingles(text: str, width: int, make) -> Column:
    """Distinct ``make(words of a shingle)`` of a text; a shorter one is a single shingle.

    The word array is bound by an outer one-element transform, so that the text is split
    once and not once per shingle.
    """
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: make(F.slice(w, i, F.lit(width)))))

    return F.array_distinct(F.transform(F.array(words(text)), of)[0])


def hashed_shingles(text: str = "text", width: int = WORDS) -> Column:
    return _shingles(text, width, lambda s: F.xxhash64(s))


def text_shingles(text: str = "text", width: int = WORDS) -> Column:
    return _shingles(text, width, lambda s: F.array_join(s, " "))


def item_sketches(items: DataFrame, width: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(h, partition): the MinHash sketch of every item, its smallest shingle hashes.

    Items are partitioned by size (powers of two of their distinct shingles).  A document
    that holds the share c of an item's q shingles misses at most q - ceil(c q) of them, so
    one of the item's q - ceil(c q) + 1 smallest hashes is in it for certain.  The sketch of
    a partition is as long as its largest possible item asks for.
    """
    hashes = items.select(F.array_sort(hashed_shingles(width=width)).alias("hs")).where(F.size("hs") > 0)
    part = F.floor(F.log2(F.size("hs")))
    largest = F.pow(F.lit(2), part + 1) - 1
    keep = (F.floor(largest * (1 - containment) + 1e-9) + 1).cast("int")
    return (hashes.select(part.cast("int").alias("partition"), F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))
            .distinct())


def contained_items(docs: DataFrame, items: DataFrame, width: int = WORDS,
                    containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, key, item_id, n_shingles, n_shared, containment): items of which a document
    holds at least ``containment`` of the distinct word shingles; ``key`` is the text's row key.

    ``items`` has item_id and text.  One row per distinct document (doc_id and text) and
    item row; repeated rows change nothing.  Null or wordless texts match nothing, ids may be
    null, other columns are ignored; with either table empty the result is empty.
    Every document shingle that could meet a sketch is looked up, whole texts included; only
    candidate documents are compared exactly, on the shingles themselves.

    An item of fewer words than ``width`` is one shingle of its own width and is looked for
    among document shingles of that width, so it is found wherever its words follow each other;
    only widths that occur among the items are made.  Text without spaces is one word.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = saved(items.withColumn("width", F.least(F.size(words()), F.lit(width))).where("width > 0"), "wanted")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    keyed = own.withColumn("oid", ordered_id()).withColumn("key", row_key())
    found = None
    for each in widths or [width]:
        part = _contained(keyed, items.where(F.col("width") == each), each, containment)
        found = part if found is None else found.unionByName(part)
    return found


def _contained(keyed: DataFrame, items: DataFrame, width: int, containment: float) -> DataFrame:
    """:func:`contained_items` for items of at least ``width`` words."""
    sketches = saved(item_sketches(items, width, containment), "sketches")
    # one number per size partition: no hash above it is in the partition's sketches
    tops = [r[0] for r in sketches.groupBy("partition").agg(F.max("h")).select("max(h)").collect()]
    top = max(tops, default=0)
    probes = keyed.select("oid", "key", F.explode(
        F.filter(hashed_shingles(width=width), lambda h: h <= F.lit(top))).alias("h"))
    candidates = saved(probes.join(sketches.select("h").distinct(), "h", "left_semi")
                       .select("oid", "key").distinct(), "candidates")

    wanted = items.select("item_id", F.xxhash64("text").alias("item_key"),
                          text_shingles(width=width).alias("ss")).where(F.size("ss") > 0)
    wanted = saved(wanted.select("item_id", "item_key", F.size("ss").alias("n_shingles"),
                                 F.explode("ss").alias("s")), "items")
    held = (keyed.join(candidates, ["oid", "key"], "left_semi")
            .select("doc_id", "key", F.explode(text_shingles(width=width)).alias("s")).distinct())
    shared = (held.join(wanted, "s").groupBy("doc_id", "key", "item_id", "item_key", "n_shingles")
              .agg(F.count("*").alias("n_shared")))
    return (shared.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
            .select("doc_id", "key", "item_id", "n_shingles", "n_shared",
                    (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def without_items(docs: DataFrame, items: DataFrame, width: int = WORDS,
                  containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see :func:`contained_items`)."""
    found = contained_items(docs, items, width, containment)
    found = saved(found.select(ordered_id().alias("oid"), "key").distinct(), "leaks")
    same = (ordered_id() == found.oid) & (row_key() == found.key)
    return docs.join(found, same, "left_anti")
