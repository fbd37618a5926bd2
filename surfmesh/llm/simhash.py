"""Near duplicates by SimHash, paired by covering locality-sensitive hashing.

Every text gets a 64-bit SimHash of its word shingles. Bit i of a fingerprint is given a vector m(i) of radius + 1 bits; table v (any
non-zero vector of as many bits) keeps the bits whose m(i) has odd overlap with v. At most `radius` differing bits span a proper
subspace, so some table keeps none of them: every pair within the radius shares a bucket of some table, without exception.

Copies collapse first: buckets hold distinct fingerprints. A bucket hands on a spanning forest of its links, never all its pairs; a
bucket of more than BUCKET fingerprints is dealt in blocks, each pair of blocks to a task of its own.

A radius that covers is a small one. keep_one_similar() links by similarity, so its fingerprints are longer: the masks cover each of PARTS parts
by itself, and fingerprints that share a bucket of any part and differ in few of the CHECK words fall in one group. Inside a group every pair
within SIMILAR_RADIUS bits of the first word is compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, at, connected_components, cut, map_arrow, packed, row_hash, unpacked

BITS = 64
#: Fingerprints of a bucket that one task compares; larger buckets are dealt in blocks of about as many.
BUCKET = 4096
#: Distinct shingles, over all texts of a block, that a block of keep_one_similar() holds at most, but for chance and a longer text (8 bytes each).
BLOCK_SHINGLES = 4 << 20
#: Parts of a long fingerprint, their bits, and the radius that masks cover in each. Pairs within PARTS * (PART_RADIUS + 1) - 1 bits of all parts
#: share a bucket without exception; a pair at similarity 0.8 (0.15 of the bits expected) shares none with a chance of about 2e-5.
PARTS, PART, PART_RADIUS = 16, 21, 2
#: Sets of at most so many shingles differ in more bits (0.19 of them); these have tables of a greater radius besides.
SMALL, SMALL_RADIUS = 5, 3
#: Words of 64 bits, before the parts, that a fingerprint carries into its buckets, and the differing bits that a pair at similarity 0.8 has in
#: them at most, but for a chance of about 6e-9 (small sets: 1e-5); unrelated pairs pass with one of about 1e-7.
CHECK, CHECK_RADIUS = 3, 60
WORDS = CHECK + -(-PARTS * PART // BITS)
#: Differing bits of the first word that a pair at similarity 0.8 has at most, but for a chance of about 1e-6 (small sets: 1e-5).
SIMILAR_RADIUS = 26
#: Rows that are compared in one step, and the longest bucket among them that isn't searched by itself.
_STEP, _SHORT = 1 << 16, 128
_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, WORDS, dtype=np.uint64)
_CACHE = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number: 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    n = len(grams)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=n).view(np.uint8).reshape(n, 8)
    set_in = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, fp, *keep) of every row; keep names columns of 64-bit numbers to carry along. A null text has no words."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fp = pa.array((simhash(texts[i].as_py() or b"", shingle) for i in range(batch.num_rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, *(batch.column(1 + k) for k in range(len(keep)))], names=[id_col, "fp", *keep])

    picked = docs.select(at(id_col).cast("long").alias(id_col), *map(at, keep), at(text_col).cast("string").cast("binary").alias("_text"))
    return map_arrow(picked, stage, f"{id_col} long, fp long" + "".join(f", {k} long" for k in keep))


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers. m(i) runs through the non-zero vectors in turn."""
    vectors = range(1, 1 << radius + 1)
    masks = [sum(1 << i for i in range(BITS) if (v & (i % len(vectors) + 1)).bit_count() & 1) for v in vectors]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius that connect what is connected: (fingerprint, root) of a forest."""
    fps, left, roots = np.unique(fps), None, []
    root = np.full(len(fps), -1)
    left = np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        root[start], front = start, [start]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= radius
            if near.any():
                found = left[near]
                root[found], left = start, left[~near]
                front.extend(found)
        roots.append(start)
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def link_forest(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of fps (fp), connecting just those that chains of links within the radius do.

    Exact for all inputs: each pair within the radius meets in a bucket, or in a pair of blocks of a large one.
    """
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "k"))
    full = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(full, ["t", "k"]).withColumn("c", F.ceil(F.col("n") / BUCKET).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("c")).cast("int")
    dealt = met.withColumn("own", own).select("t", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    dealt = dealt.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    by = ["t", "k", "i", "j"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def links() -> Iterable[pa.RecordBatch]:
            a, b = forest(np.concatenate(held), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip([0, *starts], [*starts, len(fp)], strict=True):
                now = tuple(c[lo] for c in cols)
                if key is not None and now != key:
                    yield from links()
                    held = []
                key = now
                held.append(fp[lo:hi])
        if held:
            yield from links()

    return map_arrow(dealt.repartition(*by).sortWithinPartitions(*by), stage, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, fp, component_id, root) of every row: fingerprints link at `radius` or fewer differing bits; component_id is the smallest id
    reachable by links, its own included; root is a fingerprint that names the component.

    Null and wordless texts have fingerprint 0, linked like any other. Rows with a null id are linked too; a component of such rows alone
    has a null component_id. Repeated rows come back as often as they went in. An empty table gives an empty table. Other columns of docs
    are not read.
    """
    return components(cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)), id_col=id_col, radius=radius)


def components(prints: DataFrame, *, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """prints (id_col, fp, ...) with component_id; near_duplicates after its fingerprints are made."""
    reps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    linked = connected_components(link_forest(reps.select("fp"), radius))
    roots = reps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs without all but one row of each component, all columns as they were: that with the smallest id stays (null ids last).

    Of rows that share that id, that with the smallest digest stays; of wholly equal ones, one. Null and wordless texts are one component; an
    empty table gives an empty table.
    """
    digest = packed(docs, _id=at(id_col).cast("long"), _row=row_hash(docs), _text=at(text_col))
    prints = cut(fingerprints(digest, id_col="_id", text_col="_text", shingle=shingle, keep=("_row",)))
    ranked = components(prints, id_col="_id", radius=radius)
    order = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    stays = ranked.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("_i"), F.col("o.row").alias("_r")).distinct()
    kept = digest.join(stays, (F.col("_row") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    return kept.drop("_text").dropDuplicates(["_id", "_row"]).select(*unpacked(docs.columns))


def shingle_set(text: bytes, cache: dict[bytes, int], shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; of fewer words, of them all; none without words."""
    words = text.translate(_LOWER).split()
    if len(cache) > _CACHE:
        cache.clear()
    h = np.array([cache[w] if w in cache else cache.setdefault(w, xxhash.xxh64_intdigest(w, 43)) for w in words], dtype=np.uint64)
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1 if k else 0, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_print(grams: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes that isn't empty, of WORDS signed 64-bit numbers."""
    set_in = np.zeros(BITS * WORDS, dtype=np.int64)
    for lo in range(0, len(grams), 255):  # what eight bits can count
        mixed = grams[lo : lo + 255, None] + _SEEDS
        mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        set_in += np.unpackbits((mixed ^ mixed >> np.uint64(31)).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(grams)).view(np.int64)


def table_weights(radius: int = PART_RADIUS) -> np.ndarray:
    """(bits of all parts, tables): what each bit that a table keeps counts in its key. Masks are as in covering_masks(), for each part."""
    vectors = range(1, 1 << radius + 1)
    weights = np.zeros((PARTS * PART, PARTS * len(vectors)), dtype=np.float32)
    for part in range(PARTS):
        for v in vectors:
            kept = [i for i in range(PART) if (v & (i % len(vectors) + 1)).bit_count() & 1]
            weights[[part * PART + i for i in kept], part * len(vectors) + v - 1] = [1 << k for k in range(len(kept))]
    return weights


def table_keys(prints: np.ndarray, weights: np.ndarray, first: int = 0) -> np.ndarray:
    """(prints, tables): the bucket of every fingerprint in every table, no two tables (numbered from first) having one in common."""
    bits = np.unpackbits(np.ascontiguousarray(prints[:, CHECK:]).view(np.uint8), axis=1)[:, : PARTS * PART]
    return (bits.astype(np.float32) @ weights).astype(np.int32) + (np.arange(first, first + weights.shape[1], dtype=np.int32) << PART)


def check_forest(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, least place) that connect what pairs within CHECK_RADIUS bits of the words (and SIMILAR_RADIUS of the first) do."""
    left, root = np.arange(len(words[0])), np.arange(len(words[0]))
    while len(left):
        start, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            some = left[np.bitwise_count(words[0][left] ^ words[0][k]) <= SIMILAR_RADIUS]
            some = some[sum(np.bitwise_count(w[some] ^ w[k]).astype(int) for w in words) <= CHECK_RADIUS]
            if len(some):
                root[some] = start
                front.extend(some)
                left = left[~np.isin(left, some)]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def short_forest(run: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """check_forest() of many short runs at once, run naming the run of each place in order."""
    left, right = [], []
    for d in range(1, len(run)):
        same = run[d:] == run[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same & (np.bitwise_count(words[0][d:] ^ words[0][:-d]) <= SIMILAR_RADIUS))
        i = i[sum(np.bitwise_count(w[i] ^ w[i + d]).astype(int) for w in words) <= CHECK_RADIUS]
        left.append(i)
        right.append(i + d)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (left, right))
    root, before = np.arange(len(run)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def bucket_links(by: int, limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """The stage that links the CHECK words after `by` key columns, sorted by these: (-1, first words of a link, zeros). Rows of buckets of more
    than `limit` come back as they were, under their key."""
    names = ["key", *(f"w{k}" for k in range(CHECK))]

    def links(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterable[pa.RecordBatch]:
        if len(a):
            none = np.zeros(len(a), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.full(len(a), -1, dtype=np.int32), *(words[0].view(np.int64)[x] for x in (a, b)), *[none] * (CHECK - 2)))), names=names)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, over = 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                if batch.num_rows:
                    held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(by + CHECK)])
                    rows += batch.num_rows
                if rows < _STEP:
                    continue
            if not held:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            run = np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0))])
            size = np.bincount(run)
            large = size > (rows if limit is None else limit)
            large[0] |= over is not None and cols[0][0] == over  # what stood before it has gone already
            whole = np.ones(len(size), dtype=bool)
            whole[-1] = batch is None or large[-1]
            over = cols[0][-1] if large[-1] else None
            passed = large[run]
            if passed.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[k][passed]) for k in (0, *range(by, by + CHECK))], names=names)
            short = (whole & ~large & (size <= _SHORT))[run]
            words = [c[short].view(np.uint64) for c in cols[by:]]  # as bits of signed numbers are counted in their absolute value
            yield from links(words, *short_forest(run[short], words))
            ends = np.cumsum(size)
            for k in np.flatnonzero(whole & ~large & (size > _SHORT)):
                words = [c[ends[k] - size[k] : ends[k]].view(np.uint64) for c in cols[by:]]
                yield from links(words, *check_forest(words))
            held = [] if whole[-1] else [[c[ends[-1] - size[-1] :] for c in cols]]
            rows = len(held[0][0]) if held else 0

    return stage


def covering_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the first words of long fingerprints (size, print), connecting those that share a bucket of some table and lie within
    CHECK_RADIUS bits of the CHECK words (and SIMILAR_RADIUS of the first); size tells which are in the tables for small sets too. Buckets of more than BUCKET are dealt in blocks, each pair of blocks to a task of its own."""
    weights, wider, words = table_weights(), table_weights(SMALL_RADIUS), [f"w{k}" for k in range(CHECK)]
    schema = "key int" + "".join(f", {w} long" for w in words)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
            small = every[batch.column(0).to_numpy(zero_copy_only=False) <= SMALL]
            for of, table, first in ((every, weights, 0), (small, wider, weights.shape[1])):
                for lo in range(0, len(of), 500):
                    keys = table_keys(of[lo : lo + 500], table, first)
                    carried = [np.repeat(of[lo : lo + 500, k], keys.shape[1]) for k in range(CHECK)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *carried)], names=["key", *words])

    keyed = map_arrow(prints.select("size", "print"), stage, schema)
    met = cut(map_arrow(keyed.repartition("key").sortWithinPartitions("key", "w0"), bucket_links(1, BUCKET), schema))
    found, left = (met.where(c).drop(*gone) for c, gone in (("key = -1", ("key", *words[2:])), ("key >= 0", ())))
    full = left.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("c"))
    own = F.pmod(F.xxhash64(*words, F.lit(7)), F.col("c")).cast("int")
    dealt = left.join(full, "key").withColumn("own", own).select("key", "own", *words, F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"))
    by = ["key", "i", "j"]
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *words)
    rest = map_arrow(dealt.repartition(*by).sortWithinPartitions(*by, "w0"), bucket_links(3, None), schema)
    return fewer_links(found.unionByName(rest.select("w0", "w1")).toDF("a", "b"))


def fewer_links(links: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links (a, b) do: each a keeps its least b, which takes the place of a in its other links. Where many
    nodes have a link in every table, these are mostly the same few."""
    own = links.where("a <> b").repartition("a").distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
    others = own.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.select("a", F.col("m").alias("b")).unionByName(others).distinct()


def similar_forest(sets: list[np.ndarray], fps: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (place, place) that connect what pairs of Jaccard similarity `threshold` and up, within SIMILAR_RADIUS bits, connect."""
    size = np.array([len(s) for s in sets])
    left, links = np.arange(len(sets)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[k]) <= SIMILAR_RADIUS
            near &= np.minimum(size[left], size[k]) >= threshold * np.maximum(size[left], size[k])
            some = left[near]
            if not len(some):
                continue
            flat = np.concatenate([sets[i] for i in some])
            place = np.searchsorted(sets[k], flat)
            same = (sets[k][np.minimum(place, size[k] - 1)] == flat).astype(np.int64)
            common = np.add.reduceat(same, np.cumsum(size[some]) - size[some])
            found = some[common >= threshold * (size[some] + size[k] - common)]
            links += [(int(k), int(i)) for i in found]
            front.extend(found)
            left = left[~np.isin(left, found)]
    return links


SETS = "_id long, _row long, sd long, size long, print array<long>"


def set_prints(digest: DataFrame, shingle: int = 5) -> DataFrame:
    """SETS of every row of digest (_id, _row, _text): a digest of the set of shingles (0 for none), its size and its long fingerprint (zeros for none)."""
    schema = arrow_schema(SETS)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            sd, size, prints = [], [], []
            for x in batch.column(2):
                grams = shingle_set(x.as_py() or b"", cache, shingle)
                sd.append(xxhash.xxh64_intdigest(grams.tobytes(), 44) - (1 << 63) if len(grams) else 0)
                size.append(len(grams))
                prints.append(set_print(grams) if len(grams) else [0] * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sd, pa.int64()), pa.array(size, pa.int64()), pa.array(prints, schema.field("print").type)], schema=schema)

    return map_arrow(digest.select("_id", "_row", F.col("_text").cast("string").cast("binary").alias("_text")), stage, SETS)


def similar_links(grouped: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Edges (a, b) between digests of sets, from the texts (c, i, j, own, sd, fp, _text) of the pair of blocks i and j of group c."""
    by = ["c", "i", "j"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        sds: list[int] = []
        fps: list[int] = []
        sets: list[np.ndarray] = []
        key = None

        def links() -> Iterable[pa.RecordBatch]:
            found = similar_forest(sets, np.array(fps, dtype=np.int64).view(np.uint64), threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([sds[x[k]] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for c, i, j, sd, fp, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key is not None and (c, i, j) != key:
                    yield from links()
                    sds, fps, sets = [], [], []
                key = (c, i, j)
                sds.append(sd)
                fps.append(fp)
                sets.append(shingle_set(text, cache, shingle))
        if sets:
            yield from links()

    return map_arrow(grouped.select(*by, "sd", "fp", "_text").repartition(*by).sortWithinPartitions(*by), stage, "a long, b long")


def keep_one_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without all but one row of each group that pairs of at least `threshold` Jaccard similarity of their word shingles chain together.

    Pairs whose long fingerprints share a bucket of a covering table are compared exactly. One is missed if it shares none (at similarity 0.8 a
    chance of about 2e-5, less above; sets of four and five shingles have wider tables besides) or lies beyond CHECK_RADIUS or SIMILAR_RADIUS bits
    (about 1e-6, small sets 2e-5) and nothing else links it; none is linked below the threshold. Case (of ASCII letters) and white space don't count; null and
    wordless texts are copies of each other. What stays, and what becomes of repeated rows, empty tables and columns, is as for keep_one(). The
    tables are for a threshold of 0.8 or more.
    """
    digest = packed(docs, _id=at(id_col).cast("long"), _row=row_hash(docs), _text=at(text_col))
    prints = cut(set_prints(digest, shingle))
    reps = prints.groupBy("sd").agg(F.min("_row").alias("_rep"), F.first("size").alias("size"), F.first("print").alias("print"))
    # A smaller set is similar to none but itself: another has at least one shingle more, or one other.
    reps = reps.where(F.col("size") >= threshold * (F.col("size") + 1)).withColumn("fp", F.col("print")[0])
    loose = connected_components(covering_links(reps)).select(F.col("node").alias("fp"), "root")
    grouped = reps.drop("print").join(loose, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Groups are dealt in blocks, by texts and by shingles, each pair of blocks to a task of its own.
    blocks = grouped.groupBy("root").agg(F.count("*").alias("of"), F.ceil(F.greatest(F.count("*") / BUCKET, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("sd", F.lit(7)), F.col("n")).cast("int")
    named = grouped.join(blocks.where("of > 1"), "root").select(F.col("root").alias("c"), "sd", "_rep", "fp", own.alias("own"), "n")
    texts = digest.select(F.col("_row").alias("_rep"), F.col("_text").cast("string").cast("binary").alias("_text"))
    held = named.join(texts, "_rep").dropDuplicates(["sd"])
    dealt = held.select("c", "sd", "fp", "own", "_text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("c", "sd", "fp", "_text", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    linked = connected_components(similar_links(dealt, shingle, threshold)).select(F.col("node").alias("sd"), "root")
    ranked = prints.select("_id", "_row", "sd").join(linked, "sd", "left").withColumn("root", F.coalesce("root", "sd"))
    order = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    stays = ranked.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias("_i"), F.col("o.row").alias("_r")).distinct()
    kept = digest.join(stays, (F.col("_row") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    return kept.drop("_text").dropDuplicates(["_id", "_row"]).select(*unpacked(docs.columns))
