"""Benchmark decontamination with DataFrame functions alone.

Windows of a document as long as a benchmark item (in words) get a 64-bit SimHash of their five-word shingles. Fingerprints are cut in
BLOCKS blocks; two that differ in at most RADIUS bits agree in some block up to RADIUS // BLOCKS bits, so an index of every item block
with all its neighbours within that many bits finds all items within the radius by equi-joins. Candidates are then compared exactly, by the
weighted Jaccard similarity of their shingles (weight: how often a shingle occurs).

Which windows are looked at: those that start at a shingle of an item of their length (or end with the document). That loses nothing: a
similar window shares a shingle with the item, and moving it right, to the first one that it shares, only drops shingles that aren't the
item's, so its similarity doesn't fall.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import at, cut, packed, unpacked

BITS, BLOCKS = 64, 8
#: Chance that a pair at similarity 0.8 differs in more bits than this: about 1e-6 (binomial, 0.15 of 64 bits expected).
RADIUS = 23
#: Rows of a benchmark-sided table that are broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: Column, n: int) -> Column:
    """Hashes of the n-word shingles of a text, in order; one for a shorter text, none for a text without words. Words are runs of letters
    and digits, in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashed),
        lambda h: F.when(F.size(h) == 0, F.expr("array()").cast("array<bigint>"))
        .when(F.size(h) < n, F.array(F.aggregate(h, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))),
    )[0]


def simhash(grams: Column) -> Column:
    """The SimHash of an array of hashes: bit i is set if it is in more than half of them."""
    lanes, low = F.lit(0x0000000100000001), F.lit(0xFFFFFFFF)

    def lane(k: int) -> Column:  # counts of bits k and k + 32, side by side
        return F.aggregate(grams, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(lanes))

    sums = F.array(*(lane(k) for k in range(32)))
    one = lambda count, bit: F.when(2 * count > F.size(grams), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    def bits(s: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(32):
            out = out.bitwiseOR(one(F.get(s, F.lit(k)).bitwiseAND(low), k)).bitwiseOR(one(F.shiftrightunsigned(F.get(s, F.lit(k)), 32), k + 32))
        return out

    return F.transform(F.array(sums), bits)[0]


def block(fp: Column, k: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1))


def flips(radius: int = RADIUS) -> list[int]:
    """All patterns of up to radius // BLOCKS bits of a block."""
    width = BITS // BLOCKS
    return [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(id_col, _row, item_col, similarity, start_word, n_shingles): each document and item where some window of the item's length is at
    least `threshold` similar, with its most similar window (the first of equals). _row is the hash of the text.

    Null or wordless texts and items match nothing; of texts with fewer shingles than the item the whole text is the window. Items and
    documents with null ids match like others; an item of fewer than `words` words matches only texts that it is the whole of (in words),
    never a passage of a longer one; rows equal in id and text come back once. An empty table of documents or of items gives an empty table. Other
    columns are not read.
    """
    items = benchmark.select(at(item_col).alias("_item"), shingles(at(item_text_col), words).alias("_b")).where(F.size("_b") > 0).distinct()
    items = items.withColumn("_n", F.size("_b")).withColumn("_ifp", simhash(F.col("_b")))
    n_items, n_grams = items.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()

    grams = items.select(F.explode("_b").alias("_g"), "_n").distinct()
    texts = docs.select(at(id_col).alias("_id"), F.coalesce(F.xxhash64(at(text_col).cast("string")), F.lit(0)).alias("_row"), at(text_col).alias("_text"))
    # Only hashes and places go through the explosion: an array beside them would be copied for every shingle.
    hits = texts.select("_id", "_row", F.posexplode(shingles(F.col("_text"), words)).alias("_p", "_g")).join(_held(grams, n_grams), "_g")
    places = cut(hits.groupBy("_id", "_row").agg(F.collect_set(F.struct(F.col("_p").alias("p"), F.col("_n").alias("n"))).alias("_places")))
    n_hits = places.agg(F.coalesce(F.sum(F.size("_places")), F.lit(0))).first()[0]
    named = places.select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), "_places")
    held = texts.join(_held(named, n_hits), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r"))).dropDuplicates(["_id", "_row"])

    def windows_of(a: Column) -> Column:
        starts = F.array_distinct(F.transform("_places", lambda s: F.struct(F.greatest(F.lit(0), F.least(s["p"], F.size(a) - s["n"])).alias("at"), s["n"].alias("n"))))
        return F.transform(starts, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.slice(a, s["at"] + 1, s["n"]).alias("w")))

    windows = held.select("_id", "_row", F.explode(F.transform(F.array(shingles(F.col("_text"), words)), windows_of)[0]).alias("s"))
    windows = windows.select("_id", "_row", F.col("s.n").alias("_n"), F.col("s.at").alias("_at"), F.col("s.w").alias("_w")).withColumn("_fp", simhash(F.col("_w")))

    near = F.explode(F.array(*(F.lit(x).cast("bigint") for x in flips(radius))))
    index = items.select("_item", "_n", "_ifp", F.posexplode(F.array(*(block(F.col("_ifp"), k) for k in range(BLOCKS)))).alias("_k", "_v"))
    index = index.select("_item", "_n", "_ifp", "_k", "_v", near.alias("_x")).withColumn("_v", F.col("_v").bitwiseXOR(F.col("_x"))).drop("_x")
    probes = windows.select("*", F.posexplode(F.array(*(block(F.col("_fp"), k) for k in range(BLOCKS)))).alias("_k", "_v"))
    found = probes.join(_held(index, n_items * BLOCKS * len(flips(radius))), ["_n", "_k", "_v"])
    # A pair that meets in several blocks counts in the first one alone.
    differ = F.col("_fp").bitwiseXOR(F.col("_ifp"))
    meets = [F.bit_count(block(differ, k)) <= radius // BLOCKS for k in range(BLOCKS)]
    first = F.coalesce(*(F.when(m, F.lit(k)) for k, m in enumerate(meets)))
    found = found.where((F.bit_count(differ) <= radius) & (F.col("_k") == first)).select("_id", "_row", "_item", "_n", "_at", "_w")

    again = items.select(F.col("_item").alias("_i2"), F.col("_n").alias("_n2"), "_b", F.filter(F.array_distinct("_b"), lambda x: F.size(F.filter("_b", lambda y: y == x)) > 1).alias("_many"))
    pairs = found.join(_held(again, n_items), F.col("_item").eqNullSafe(F.col("_i2")) & (F.col("_n") == F.col("_n2")))
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    common = F.size(F.array_intersect("_w", "_b")) + F.aggregate("_many", F.lit(0), lambda s, x: s + F.greatest(F.lit(0), F.least(times("_w", x), times("_b", x)) - 1))
    pairs = pairs.withColumn("_c", common).withColumn("similarity", F.col("_c") / (F.size("_w") + F.size("_b") - F.col("_c"))).where(F.col("similarity") >= threshold)
    best = pairs.groupBy("_id", "_row", "_item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("_at").alias("at"), F.col("_n").alias("n"))).alias("m"))
    return best.select(F.col("_id").alias(id_col), "_row", F.col("_item").alias(item_col), (-F.col("m.s")).alias("similarity"), F.col("m.at").cast("long").alias("start_word"), F.col("m.n").cast("long").alias("n_shingles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that match an item; all columns as they were, whatever they are called. Options as for matches().

    Rows with null ids, and null and wordless texts, match and stay as for matches(); repeated rows stay or go together; without items all rows stay.
    """
    bad = matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("_bad_id"), F.col("_row").alias("_bad_row")).distinct()
    rows = packed(docs, _id=at(id_col), _hash=F.coalesce(F.xxhash64(at(text_col).cast("string")), F.lit(0)))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_hash") == F.col("_bad_row")), "left_anti").select(*unpacked(docs.columns))
