"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

directory() is the table to keep: (cell, bits, depth), by which sharded(cells=...) finds the shards of later rows too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import at, cut, md5_bits, numbered, packed, unpacked

#: Bits that a look at the data goes deeper than an even spread would need; what is too large there is looked at again, deeper.
EXTRA_BITS, MOST_BITS = 6, 60
#: Rows of the directory's cells that are broadcast; a larger table is joined by shuffle.
BROADCAST_ROWS = 200_000


def hash_of(id_col: Column, text_col: Column) -> Column:
    """MOST_BITS bits by which rows are dealt: of the id, or of the text where the id is null; 0 where both are."""
    return md5_bits(id_col, text_col)


def sized(docs: DataFrame, id_col: str, text_col: str, **picked: Column) -> DataFrame:
    """docs as _doc, with _h and _bytes."""
    return packed(docs, _h=hash_of(at(id_col), at(text_col)), _bytes=F.coalesce(F.octet_length(at(text_col)), F.lit(0)).cast("long"), **picked)


def directory(docs: DataFrame, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The directory (cell, bits, depth) for the rows of docs: each hash prefix of so many bits that occurs, and the depth of its bucket. An empty
    table has an empty one, which is one bucket."""
    return buckets(sized(docs, id_col, text_col).select("_h", "_bytes"), limit)


def buckets(sizes: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, cell, bits): of sizes (_h, _bytes), each hash prefix `cell` of `bits` bits and the depth of the bucket it is in.

    A bucket is split while it holds more than limit bytes; so it is the shallowest prefix that fits. Buckets that don't fit at MOST_BITS
    bits have depth MOST_BITS + 1. Every round sums the bytes by prefix, only of what didn't fit before.
    """
    total = sizes.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    known, top, bits = None, 0, min(MOST_BITS, max(1, math.ceil(math.log2(max(2, total / limit)))) + EXTRA_BITS)
    left = sizes
    while True:
        cells = left.groupBy(F.shiftright("_h", MOST_BITS - bits).alias("cell")).agg(F.sum("_bytes").alias("bytes"))
        sums = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth"))
        sums = sums.groupBy("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("at")).agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") <= limit)
        fits = cells.select("cell", F.explode(F.sequence(F.lit(top), F.lit(bits))).alias("depth")).withColumn("at", F.expr(f"shiftright(cell, {bits} - depth)"))
        fits = fits.join(sums.select("depth", "at"), ["depth", "at"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        found = cut(cells.join(fits, "cell", "left").select("cell", F.lit(bits).alias("bits"), "depth"))
        fit = found.where("depth is not null")
        known = fit if known is None else known.unionByName(fit)
        over = found.where("depth is null")
        n = over.count()
        if not n:
            return known
        if bits == MOST_BITS:
            return known.unionByName(over.withColumn("depth", F.lit(MOST_BITS + 1)))
        wide = over.select(F.col("cell").alias("_over"))
        left = left.join(F.broadcast(wide) if n <= BROADCAST_ROWS else wide, F.shiftright("_h", MOST_BITS - bits) == F.col("_over"), "left_semi")
        top, bits = bits + 1, min(MOST_BITS, bits + EXTRA_BITS)


def dealt(docs: DataFrame, cells: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **picked: Column) -> DataFrame:
    """docs as _doc, with _h, _bytes, _depth and _label (its bucket's prefix in binary) by a directory. Rows of a cell that it doesn't list have no
    depth: see settled()."""
    listed = cells.groupBy("bits").agg(F.count("*").alias("n")).orderBy("bits").collect()  # MOST_BITS / EXTRA_BITS of them at most
    rows = sized(docs, id_col, text_col, **picked)
    names = ["_doc", "_h", "_bytes", *picked]
    found = rows.withColumn("_depth", F.lit(None).cast("int"))
    for r in listed:
        level = cells.where(F.col("bits") == r.bits).select(F.col("cell").alias("_cell"), F.col("depth").alias("_d"))
        found = found.join(F.broadcast(level) if r.n <= BROADCAST_ROWS else level, F.shiftright("_h", MOST_BITS - r.bits) == F.col("_cell"), "left")
        found = found.select(*names, F.coalesce("_depth", "_d").alias("_depth"))
    return labelled(found)


def labelled(rows: DataFrame) -> DataFrame:
    prefix = F.expr(f"substring(lpad(bin(_h), {MOST_BITS}, '0'), 1, least(_depth, {MOST_BITS}))")
    return rows.withColumn("_label", F.when(F.col("_depth") <= 0, F.lit("")).otherwise(prefix))


def settled(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """dealt() rows, those of no listed cell too: they are in an empty bucket, whose prefix is the shortest that isn't one of a split bucket."""
    split = cells.select("cell", "bits", F.explode(F.sequence(F.lit(-1), F.least("depth", F.lit(MOST_BITS)) - 1)).alias("d"))
    split = split.where("d >= 0").select("d", F.expr("shiftright(cell, bits - d)").alias("at")).distinct()
    new = rows.where("_depth is null").select("_h").distinct()
    tried = new.select("_h", F.explode(F.sequence(F.lit(0), F.lit(MOST_BITS - 1))).alias("d")).withColumn("at", F.expr(f"shiftright(_h, {MOST_BITS} - d)"))
    deepest = tried.join(split, ["d", "at"]).groupBy("_h").agg((F.max("d") + 1).alias("_d"))
    found = rows.drop("_label").join(deepest, "_h", "left").withColumn("_depth", F.coalesce("_depth", "_d", F.lit(0))).drop("_d")
    return labelled(found)


def sharded(docs: DataFrame, *, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", cells: DataFrame | None = None) -> DataFrame:
    """docs with _shard (its bucket's hash prefix in binary, "" for the only bucket) and _bytes (of the text in UTF-8), by its directory, made
    here unless cells gives one that was made before; then shards may outgrow the limit by what is new in them.

    The texts of a shard have at most `limit` bytes together, but for a text that is larger alone: it has a shard of its own. Rows that
    no bit of the hash tells apart (repeated ids) and that don't fit one shard are numbered and cut in shards "prefix/number". A null
    text has no bytes; null ids are dealt by text; equal rows change places freely; an empty table gives an empty table; other columns are
    carried along, but for any that are called like those added.
    """
    later = cells is not None
    cells = cells if later else cut(directory(docs, limit=limit, id_col=id_col, text_col=text_col))
    names = unpacked(docs.columns, ("_shard", "_bytes"))
    rows = dealt(docs, cells, id_col=id_col, text_col=text_col, _text=F.xxhash64(at(text_col).cast("string")))
    rows = settled(rows, cells) if later else rows
    if not cells.where(F.col("depth") > MOST_BITS).limit(1).count():
        return rows.select(*names, F.col("_label").alias("_shard"), "_bytes")
    # Rows alike in all bits, too many for a shard: those over half the limit alone, the others so many a shard that any fit. They are numbered
    # over all tasks, however many one id has.
    easy = rows.where(F.col("_depth") <= MOST_BITS).select(*names, F.col("_label").alias("_shard"), "_bytes")
    hard = cut(rows.where(F.col("_depth") > MOST_BITS).withColumn("_big", F.col("_bytes") * 2 > limit).withColumn("_tie", F.monotonically_increasing_id()))
    hard = numbered(hard, "_n", "_h", "_big", "_bytes", "_text", "_tie")
    groups = cut(hard.groupBy("_h", "_big").agg(F.min("_n").alias("_first"), F.max("_bytes").alias("_most")))
    hard = hard.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, ["_h", "_big"])
    each = F.when(F.col("_big"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_most", F.lit(1)))))
    k = F.floor((F.col("_n") - F.col("_first")) / each).cast("string")
    name = F.concat("_label", F.when(F.col("_big"), F.lit("/large-")).otherwise(F.lit("/")), k)
    return easy.unionByName(hard.select(*names, name.alias("_shard"), "_bytes"))
