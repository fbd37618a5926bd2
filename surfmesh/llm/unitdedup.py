"""Substring dedup by unit hashing: units are normalised, their digests grouped globally, the earliest ranked occurrence stays.

Units are lines, and longer lines are paragraphs of several units: a line is also cut wherever a hash of two neighbouring words is the
least of its surroundings within the line. Such cuts depend on the words around them alone, so that a passage that was put in the middle of
other text has the same units everywhere, which whole lines would not; and a line that stands earlier too has no other units than it.

Runs of repeated units go from MIN_WORDS words on, whole repeated lines from min_line_words on, which is the same unless asked for: in prose, short
lines recur by chance, and a document isn't a copy for them. Whole repeated lines of any length are listed beside.

Every text is parsed once and its units cross one exchange, by digest. What a batch of texts shows to be no first occurrence is dealt by place
instead, so that however common a line is, no task gets more than about one row of each batch for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, map_arrow
from surfmesh.llm.spans import cut_out, keyed

#: Least words of a run of repeated units that is removed; words either side that a cut within a line looks at.
MIN_WORDS, REACH = 20, 4
#: A unit of more words is cut evenly, in quarters of so many words.
LONG = 64
_OTHER = re.compile(r"[\W_]+")
_MIX = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CACHE = 200_000


def _hash(token: str) -> int:
    """Of a token's letters and digits in lower case; 0 if it has none."""
    word = _OTHER.sub("", token.lower())
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 8) | 1 if word else 0


def units_of(text: str, cache: dict[str, int], reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit of a text: digest, words, where its first word starts and its last one ends (code points), and whether it is the first (1)
    and the last (2) of its line.

    Words are what stands between white space; only their letters and digits count, in lower case, and one without any is passed over.
    A line without words has no unit.
    """
    breaks = np.cumsum([len(line) + 1 for line in text.split("\n")])[:-1]
    for c in "\n\t\r\v\f":
        text = text.replace(c, " ")
    tokens = text.split(" ")
    if len(cache) > _CACHE:
        cache.clear()
    hashes = [cache[t] if t in cache else cache.setdefault(t, _hash(t)) for t in tokens]
    h = np.array(hashes, dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    real = np.flatnonzero(h)
    starts = np.concatenate([[0], ends[:-1] + 1])[real]
    h, ends = h[real], ends[real]
    head = np.zeros(len(h) + 1, dtype=bool)
    head[0] = True
    head[np.searchsorted(starts, breaks)] = True
    n = len(h)
    head[n] = True
    if not n:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    # A cut before word i: the pair (i-1, i) hashes lower than every pair of the line within reach. Lines begin anew.
    most = np.iinfo(np.uint64).max
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    own = np.append(most, np.where(head[1:n], most, mixed ^ mixed >> np.uint64(32)))
    line, least = np.cumsum(head[:n]), np.full(n, most, dtype=np.uint64)
    for k in range(1, min(reach, n - 1) + 1):
        same = line[k:] == line[:-k]
        least[k:] = np.minimum(least[k:], np.where(same, own[:-k], most))
        least[:-k] = np.minimum(least[:-k], np.where(same, own[k:], most))
    cut = np.flatnonzero(head[:n] | (own < least))
    size = np.diff(cut, append=n)
    if (size > LONG).any():  # words that repeat without end have no least pair
        place = np.arange(n) - np.repeat(cut, size)
        cut = np.union1d(cut, np.flatnonzero((place % (LONG // 4) == 0) & np.repeat(size > LONG, size)))
        size = np.diff(cut, append=n)
    place = np.arange(n) - np.repeat(cut, size)
    weighed = (h ^ h >> np.uint64(29)) * (_MIX[place % len(_MIX)] + np.uint64(2) * (place // len(_MIX)).astype(np.uint64))
    digest = np.add.reduceat(weighed, cut) + size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    after = np.append(cut[1:], n)
    return digest ^ digest >> np.uint64(31), size, starts[cut], ends[after - 1], head[cut] + 2 * head[after]


UNIT = "_key long, _id long, _row long, _unit int, _words int, _start int, _end int"
#: What _words holds above the count: whether a unit is the first or the last of its line, and whether its batch shows that it isn't the first
#: of its digest.
HEAD, TAIL, LATER, COUNT = 1 << 28, 1 << 29, 1 << 30, (1 << 28) - 1


def later(digest: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of these units have one of the same digest at an earlier place beside them."""
    order = np.lexsort((*reversed(place), digest))
    new = np.append(True, np.diff(digest[order].view(np.int64)) != 0)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # of each one's digest
    out = np.zeros(len(digest), dtype=bool)
    out[order] = np.any([p[order] != p[first] for p in place], axis=0)
    return out


def units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The units of every text, as in UNIT, numbered by _unit. _key is the digest; of units that are later ones for certain, a hash of the place."""
    schema = arrow_schema(UNIT)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(2)
            found = [units_of(texts[i].as_py() or "", cache) for i in range(batch.num_rows)]
            size = np.array([len(f[0]) for f in found])
            if not size.sum():
                continue
            digest, words, start, end, edge = (np.concatenate([f[k] for f in found]) for k in range(5))
            owner = np.repeat(np.arange(len(found)), size)
            unit = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)[owner]
            ids = batch.column(0).fill_null(0).to_numpy()[owner]
            row = batch.column(1).to_numpy()[owner]
            sure = later(digest, none, ids, row, unit)
            place = (row.view(np.uint64) ^ (unit + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            key = np.where(sure, place ^ place >> np.uint64(31), digest).view(np.int64)
            words = words + HEAD * (edge & 1) + TAIL * (edge >> 1) + LATER * sure
            columns = (row, *(x.astype(np.int32) for x in (unit, words, start, end)))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(owner)), *map(pa.array, columns)], schema=schema)

    return map_arrow(keyed(docs, id_col, text_col), stage, UNIT)


def repeated(all_units: DataFrame) -> DataFrame:
    """The units (_id, _row, _unit, _words, _start, _end) that aren't their digest's first."""
    order = Window.partitionBy("_key").orderBy(F.col("_id").isNull(), "_id", "_row", "_unit")
    ranked = all_units.withColumn("_rank", F.rank().over(order))
    found = ranked.where((F.col("_words") >= LATER) | (F.col("_rank") > 1))
    return found.select("_id", "_row", "_unit", F.col("_words").bitwiseAND(F.lit(LATER - 1)).alias("_words"), "_start", "_end")


def removed_runs(listed: DataFrame, min_words: int = MIN_WORDS, min_line_words: int | None = None) -> DataFrame:
    """(_id, _row, _spans, repeated_lines) of every text with repeats, from its repeated units: what goes, and all whole repeated lines."""
    text = Window.partitionBy("_id", "_row").orderBy("_unit")
    once = listed.repartition("_id", "_row").dropDuplicates(["_id", "_row", "_unit"])  # rows equal in id and text
    once = once.withColumns({"_head": F.col("_words").bitwiseAND(F.lit(HEAD)) > 0, "_tail": F.col("_words").bitwiseAND(F.lit(TAIL)) > 0, "_words": F.col("_words").bitwiseAND(F.lit(COUNT))})
    once = once.withColumns({"_run": F.col("_unit") - F.row_number().over(text), "_line": F.sum(F.col("_head").cast("int")).over(text)})
    # Of each run its lines, of each line whether both its ends are there.
    lines = once.groupBy("_id", "_row", "_run", "_line").agg(F.sum("_words").alias("n"), F.min("_start").alias("start"), F.max("_end").alias("end"), (F.max("_head") & F.max("_tail")).alias("whole"))
    span = F.struct("start", "end")
    runs = lines.groupBy("_id", "_row", "_run").agg(
        F.sum("n").alias("n"),
        F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("run"),
        F.collect_list(F.when(F.col("whole"), span)).alias("whole"),
        F.collect_list(F.when(F.col("whole") & (F.col("n") >= (min_words if min_line_words is None else min_line_words)), span)).alias("short"),
    )
    goes = F.when(F.col("n") >= min_words, F.array("run")).otherwise(F.col("short"))
    return runs.groupBy("_id", "_row").agg(F.sort_array(F.flatten(F.collect_list(goes))).alias("_spans"), F.sort_array(F.flatten(F.collect_list("whole"))).alias("repeated_lines"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int | None = None) -> DataFrame:
    """Every row's id_col, text without repeats, n_removed (code points), removed (spans of the original text) and repeated_lines (the spans
    of all whole lines that stand earlier too, gone or not).

    The earliest occurrence of a unit is that of the smallest id (null last), then the smallest hash of the text, then the first in it. Runs
    of consecutive repeated units of at least min_words words go, and whole repeated lines of at least min_line_words (min_words, unless
    given; 1: every line that stands earlier too). A line is repeated if all its units are. Rows equal in id and text count as one. A null
    text stays null; an empty table gives an empty table; other columns are not read.
    """
    removed = removed_runs(repeated(units(docs, id_col=id_col, text_col=text_col)), min_words, min_line_words)
    return cut_out(docs, removed, id_col=id_col, text_col=text_col, also=("repeated_lines",))
