"""Cutting spans out of texts: what the operators that delete repeats share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, map_arrow

CUT = "text string, n_removed long, removed array<struct<start:int,end:int>>"


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """text without these spans (code points, in order, apart)."""
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return "".join([*out, text[at:]])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _text): _row is the text's hash, so that (_id, _row) names a row up to equal ones."""
    at = lambda c: F.col(f"`{c}`")
    return docs.select(at(id_col).cast("long").alias("_id"), F.coalesce(F.xxhash64(at(text_col).cast("string")), F.lit(0)).alias("_row"), at(text_col).cast("string").alias("_text"))


def cut_out(docs: DataFrame, removed: DataFrame, *, id_col: str, text_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """id_col and the columns of CUT of every row of docs: its text without the spans that removed (_id, _row, _spans) lists for it.

    n_removed counts code points; a null text stays null. Rows equal in id and text get the same spans. also: lists of spans in removed that are
    carried along (empty where there are none).
    """
    out = f"{id_col} long, {CUT}" + "".join(f", {c} array<struct<start:int,end:int>>" for c in also)
    schema = arrow_schema(out)
    rows = keyed(docs, id_col, text_col)
    same = rows["_id"].eqNullSafe(removed["_id"]) & (rows["_row"] == removed["_row"])
    both = rows.join(removed, same, "left").select(rows["_id"], "_text", "_spans", *(F.coalesce(F.col(c), F.array()).alias(c) for c in also))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts, spans, gone = [], [], []
            for text, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = joined((x["start"], x["end"]) for x in listed or ())
                texts.append(without(text, own) if own else text)
                spans.append([{"start": lo, "end": hi} for lo, hi in own])
                gone.append(sum(hi - lo for lo, hi in own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(spans, schema.field("removed").type), *(batch.column(3 + k).cast(schema.field(c).type) for k, c in enumerate(also))], schema=schema)

    return map_arrow(both, stage, out)
