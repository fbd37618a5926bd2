"""What the operators share: Arrow stages, and columns that clash with nothing. Cuts of lineage and components are the core's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from surfmesh.plans.lineage import connected_components, cut, numbered, removed_dir, shared_dir

__all__ = ["arrow_schema", "at", "connected_components", "cut", "map_arrow", "md5_bits", "numbered", "packed", "removed_dir", "row_hash", "shared_dir", "unpacked"]

#: Bytes of text that one Arrow batch of a Python stage holds at most (a single longer text makes a batch of its own).
BATCH_BYTES = 16 << 20


def packed(docs: DataFrame, **picked: Column) -> DataFrame:
    """All columns of docs as one struct _doc, beside the picked ones: whatever docs' columns are called, they clash with nothing."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *(v.alias(k) for k, v in picked.items()))


def unpacked(names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of _doc, but for those that an operator puts in their place (by Spark's rules, whatever their case)."""
    gone = {c.lower() for c in without}
    return [F.col("_doc")[c].alias(c) for c in names if c.lower() not in gone]


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of docs; those that hold maps, which Spark doesn't hash, count as JSON."""

    def hashed(t: DataType) -> bool:
        if isinstance(t, (MapType, VariantType)):
            return False
        if isinstance(t, ArrayType):
            return hashed(t.elementType)
        return all(hashed(f.dataType) for f in t.fields) if isinstance(t, StructType) else True

    return F.xxhash64(*(at(f.name) if hashed(f.dataType) else F.to_json(F.struct(at(f.name))) for f in docs.schema.fields))


def at(name: str) -> Column:
    return F.col(f"`{name}`")


def md5_bits(id_col: Column, text_col: Column) -> Column:
    """The first 60 bits of the MD5 of an id as text, or of the text where the id is null: a hash that every SQL engine can work out. 0 where both are."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), text_col.cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.coalesce(bits, F.lit(0).cast("bigint"))


def map_arrow(df: DataFrame, stage: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in bytes as well as in rows."""
    spark = df.sparkSession
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return df.mapInArrow(stage, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema of flat columns and lists of them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))
