"""Line dedup by winnowing: repeated runs of lines are found by fingerprints, matched line by line and deleted where they come later.

The lines of a text (those with a word, white space evened out) are hashed, and so are the grams of GRAM neighbouring lines. Of every WINDOW
neighbouring grams the least is kept (the last of equals), with its place. Two texts with GRAM + WINDOW - 1 lines in a row in common share
a fingerprint for certain. Long lines are fingerprinted one by one besides, so that a repeat of more than 50 words shares one on however few
lines it stands.

Each fingerprint's later places are joined with its first one and the match is extended both ways. The first place may stand in shorter
common surroundings than a later one, so each repeated fingerprint is joined besides with the first place of every window of GRAM + WINDOW - 1
lines around it. So a run of that many lines or more that stands earlier too, wherever that is, goes to its last line: each of its
lines is in such a window within the run, and each such window has a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, cut, map_arrow
from surfmesh.llm.spans import cut_out, keyed

GRAM, WINDOW = 2, 3
#: Words, or bytes of UTF-8 (for scripts without spaces), from which on a line has a fingerprint of its own. Of three lines with more than 50
#: words one has 17 at least; more lines are the windows' part.
LONG_WORDS, LONG_BYTES = 17, 200
#: Tasks that the rows of one fingerprint, and the texts that match one text, are dealt to.
SALTS = 16


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Hash, start and end (with its line break) of every line with a word."""
    hashes, starts, ends, at = [], [], [], 0
    for line in text.split("\n"):
        if even := " ".join(line.split()):
            hashes.append(xxhash.xxh64_intdigest(even.encode("utf-8", "surrogatepass"), 5) - (1 << 63))
            starts.append(at)
            ends.append(min(len(text), at + len(line) + 1))
        at += len(line) + 1
    return hashes, starts, ends


def grams_of(hashes: list[int], gram: int = GRAM) -> np.ndarray:
    """Hashes of the runs of `gram` lines; of a shorter text, of all its lines."""
    h = np.array(hashes, dtype=np.int64).view(np.uint64)
    if not len(h):
        return h
    k = min(gram, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least gram of each window, the last of equals; of a text of fewer grams, of them all."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def long_lines(text: str) -> np.ndarray:
    """Places, among the lines with a word, of those that have a fingerprint of their own."""
    lines = [words for line in text.split("\n") if (words := line.split())]
    return np.array([k for k, words in enumerate(lines) if len(words) >= LONG_WORDS or len(" ".join(words).encode("utf-8", "surrogatepass")) >= LONG_BYTES], dtype=np.int64)


def fingerprints(text: str, hashes: list[int], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a text with these line hashes, and their places: winnowed grams and long lines."""
    grams, alone = grams_of(hashes, gram), grams_of(hashes, 1)
    places = winnow(grams, window)
    own = long_lines(text) if len(hashes) else places
    own = own[~np.isin(own, places)] if min(gram, len(hashes)) == 1 else own  # those are listed already
    return np.concatenate([grams[places], alone[own]]), np.concatenate([places, own])


def extended(a: list[int], b: list[int], p: int, q: int) -> tuple[int, int]:
    """The run of lines of a around p that equals b around q: its first line, and the one after its last."""
    back = 0
    while p - back > 0 and q - back > 0 and a[p - back - 1] == b[q - back - 1]:
        back += 1
    ahead = 0
    while p + ahead < len(a) and q + ahead < len(b) and a[p + ahead] == b[q + ahead]:
        ahead += 1
    return p - back, p + ahead


def windows_around(hashes: list[int], places: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of gram + window - 1 lines that hold the gram at one of these places (or begin with a text's only lines): the place's number in
    the list, the window's hash and where it starts."""
    wide = gram + window - 1
    if len(hashes) < wide:
        return (np.zeros(0, dtype=np.int64),) * 3
    whole = grams_of(hashes, wide)
    which = np.repeat(np.arange(len(places)), window)
    start = places[which] - np.tile(np.arange(window), len(places))
    ok = (start >= 0) & (start < len(whole))
    return which[ok], whole[start[ok]], start[ok]


LINES = "_id long, _row long, _hashes array<long>, _starts array<int>, _ends array<int>, _marks array<struct<m:long,p:int,w:array<struct<m:long,p:int>>>>"
RUNS = "_id long, _row long, start int, end int"


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The lines and fingerprints of every text, as in LINES."""
    schema = arrow_schema(LINES)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in (x.as_py() for x in batch.column(2)):
                hashes, starts, ends = lines_of(text or "")
                marks, places = fingerprints(text or "", hashes, gram, window)
                found = [{"m": m, "p": p, "w": []} for m, p in zip(marks.view(np.int64).tolist(), places.tolist(), strict=True)]
                which, wins, at = windows_around(hashes, places, gram, window)
                for k, m, p in zip(which.tolist(), wins.view(np.int64).tolist(), at.tolist(), strict=True):
                    found[k]["w"].append({"m": m, "p": p})
                rows.append((hashes, starts, ends, found))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return map_arrow(keyed(docs, id_col, text_col), stage, LINES)


def later_places(marks: DataFrame) -> DataFrame:
    """marks (_mark, _id, _row, _p, _salt, ...) that occur more than once, with the mark's first place: _id0, _row0, _q.

    The rows of one mark are dealt to SALTS tasks; only one row of each comes together to find the first.
    """
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_p").alias("p"))
    parts = marks.groupBy("_mark", "_salt").agg(F.min(place).alias("f"), F.count("*").alias("n"))
    firsts = parts.groupBy("_mark").agg(F.min("f").alias("f"), F.sum("n").alias("n"), F.collect_list("_salt").alias("s")).where("n > 1")
    firsts = firsts.select("_mark", F.explode("s").alias("_salt"), F.col("f.id").alias("_id0"), F.col("f.row").alias("_row0"), F.col("f.p").alias("_q"))
    return marks.join(firsts, ["_mark", "_salt"])


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Runs of lines (as in RUNS: offsets in the text) that extend a fingerprint's later place against its first one, and against the first
    place of each window around it."""
    schema = arrow_schema(RUNS)
    salt = F.pmod(F.xxhash64("_id", "_row"), F.lit(SALTS)).cast("int").alias("_salt")
    marks = texts.select("_id", "_row", salt, F.explode("_marks").alias("m")).select("_id", "_row", "_salt", F.col("m.m").alias("_mark"), F.col("m.p").alias("_p"), F.col("m.w").alias("_w"))
    again = cut(later_places(marks))
    names = ["_id", "_row", "_p", "_id0", "_row0", "_q"]
    around = again.select("_id", "_row", "_salt", F.explode("_w").alias("w")).select("_id", "_row", "_salt", F.col("w.m").alias("_mark"), F.col("w.p").alias("_p")).distinct()
    pairs = again.select(*names).unionByName(later_places(around).select(*names))
    pairs = pairs.where(~(F.col("_id").eqNullSafe(F.col("_id0")) & (F.col("_row") == F.col("_row0")) & (F.col("_p") == F.col("_q"))))
    # A text's places, of which it has no more than lines, by the text that they match.
    pairs = pairs.groupBy("_id", "_row", "_id0", "_row0").agg(F.collect_set(F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"))).alias("at")).withColumn("_salt", salt)
    own = texts.select("_id", "_row", "_hashes", "_starts", "_ends").dropDuplicates(["_id", "_row"])
    mine = own.select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), "_hashes", "_starts", "_ends")
    with_own = pairs.join(mine, pairs["_id"].eqNullSafe(mine["_i"]) & (pairs["_row"] == mine["_r"])).drop("_i", "_r")
    # The other text comes once for each salt that asks for it; each row takes of it no more lines than its own text could match.
    asked = pairs.select("_id0", "_row0", F.col("_salt").alias("_s")).distinct()
    there = own.select(F.col("_id").alias("_i"), F.col("_row").alias("_r"), F.col("_hashes").alias("_other"))
    there = asked.join(there, asked["_id0"].eqNullSafe(there["_i"]) & (asked["_row0"] == there["_r"])).select("_i", "_r", "_s", "_other")
    both = with_own.join(there, with_own["_id0"].eqNullSafe(there["_i"]) & (with_own["_row0"] == there["_r"]) & (with_own["_salt"] == there["_s"]))
    shift = F.transform("at", lambda x: x["q"] - x["p"])
    lo = F.greatest(F.lit(0), F.array_min(shift))
    hi = F.array_max(shift) + F.size("_hashes")
    both = both.select("_id", "_row", "at", lo.alias("_lo"), F.slice("_other", lo + 1, F.greatest(F.lit(0), hi - lo)).alias("_other"), "_hashes", "_starts", "_ends")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row, at, lo0, other, own, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done: dict[int, list[tuple[int, int]]] = {}  # by the distance of the two places
                for p, q in sorted((x["p"], x["q"] - lo0) for x in at):
                    spans = done.setdefault(p - q, [])
                    if not spans or p >= spans[-1][1]:
                        spans.append(extended(own, other, p, q))
                out += [(i, row, starts[lo], ends[hi - 1]) for spans in done.values() for lo, hi in spans]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return map_arrow(both, stage, RUNS)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every row's id_col, text without later repeated runs, n_removed (code points) and removed (spans of the original text).

    The earlier of two places is that of the smallest id (null last), then of the smallest hash of the text, then the first in it. A run goes
    if it equals the lines around the first place of a fingerprint, or of a window around a repeated one. So gram + window - 1 lines in a row and
    more that stand earlier too always go, and so does every line of LONG_WORDS words or LONG_BYTES bytes; shorter lines in runs of fewer
    may stay. A text of fewer lines goes when all its lines are another text's whole content or a gram of it. Blank lines are passed
    over; rows equal in id and text count as one. A null text stays null; an empty table gives an empty table; other columns are not read.
    """
    texts = cut(lines(docs, id_col=id_col, text_col=text_col, gram=gram, window=window))
    runs = repeated_runs(texts).groupBy("_id", "_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    return cut_out(docs, runs, id_col=id_col, text_col=text_col)
