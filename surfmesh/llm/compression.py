"""Quality rules: word counts and repetition, then bands of zstandard ratios over whole documents and over fixed chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, map_arrow

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed bytes / bytes by length: (least bytes, lowest ratio, highest ratio), by rising length.

    Every length has a band (of texts under 64 bytes the
    format's own frame is a good part). chunk_bytes cuts a text in chunks; a last piece shorter than
    half a chunk joins the one before. The default limits leave a margin around the range of labelled good prose of each length; prose
    with symbol noise or repetition compresses better, encoded or random bytes worse. A text is rejected if its own ratio leaves the band of its length, or if more than
    chunk_share of its chunks leave theirs.
    """

    limits: tuple[tuple[int, float, float], ...] = ((1, 0.85, 1.60), (64, 0.65, 1.25), (128, 0.45, 1.00), (512, 0.455, 0.75), (2048, 0.415, 0.62), (8192, 0.395, 0.58), (32768, 0.375, 0.55))
    chunk_bytes: int = 4096
    chunk_share: float = 0.5
    level: int = 3
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    starts: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "starts", tuple(x[0] for x in self.limits))

    def within(self, n_bytes: int, ratio: float) -> bool:
        k = int(np.searchsorted(self.starts, n_bytes, side="right")) - 1
        return k < 0 or self.limits[k][1] <= ratio <= self.limits[k][2]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of so many words that occur at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    base, key = len(known), ids[:n]
    high = base
    for k in range(1, window):
        if high * base >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            high = len(seen)
        key, high = key * base + ids[k : k + n], high * base
    ranked = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[ranked]) == 0)
    if not len(same):
        return 0
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.union1d(ranked[same], ranked[same + 1])
    starts[at] += 1
    starts[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(starts)[: len(words)]))


def base_counts(text: str, raw: bytes, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (raw: its UTF-8)."""
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, window))


def ratios(raw: bytes, packer: zstandard.ZstdCompressor, chunk_bytes: int) -> tuple[float, list[tuple[int, float]]]:
    """The ratio of the whole text, and (bytes, ratio) of each of its chunks (none where one chunk holds it all)."""
    if not raw:
        return 0.0, []
    whole = len(packer.compress(raw)) / len(raw)
    ends = [*range(chunk_bytes, len(raw) - chunk_bytes // 2 + 1, chunk_bytes), len(raw)]
    if len(ends) == 1:
        return whole, []
    return whole, [(hi - lo, len(packer.compress(raw[lo:hi])) / (hi - lo)) for lo, hi in zip([0, *ends], ends, strict=False)]


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Counts and verdict of every row: id_col and the columns of OUT.

    A null or empty text has no words, ratio 0 and fails the base rules. Null ids and repeated rows are rows like any other; an empty
    table gives an empty table; other columns of docs are not read. Every text is judged whole, however long.
    """
    schema = arrow_schema(f"{id_col} long, {OUT}")

    def judge(text: str, packer: zstandard.ZstdCompressor) -> tuple:
        raw = text.encode()
        counts = base_counts(text, raw, bands.window)
        failed = counts[0] < bands.min_words or 100 * counts[4] > bands.max_repeat_percent * counts[0]
        whole, chunks = ratios(raw, packer, bands.chunk_bytes)
        bad = sum(not bands.within(n, r) for n, r in chunks)
        kept = not failed and bands.within(len(raw), whole) and bad <= bands.chunk_share * len(chunks)
        return (*counts, failed, kept, whole, len(chunks), bad)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [judge(batch.column(1)[i].as_py() or "", packer) for i in range(batch.num_rows)]
            columns = zip(*rows, strict=True) if rows else [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")), stage, f"{id_col} long, {OUT}")
