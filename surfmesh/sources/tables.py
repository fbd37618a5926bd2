"""Maps as Parquet folders: a table for each part, layer values partitioned by layer so that one layer is read alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from surfmesh import types as T
from surfmesh.operators.mesh import MeshMap

PARTS = {"vertices": T.VERTICES, "navcels": T.NAVCELS, "surfaces": T.SURFACES, "surface_navcels": T.SURFACE_NAVCELS, "layers": T.LAYERS, "layer_values": T.LAYER_VALUES}


def save(mesh: MeshMap, path: str, mode: str = "error") -> None:
    for part in PARTS:
        writer = getattr(mesh, part).write.mode(mode)
        (writer.partitionBy("layer") if part == "layer_values" else writer).parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str) -> MeshMap:
    return MeshMap(**{part: spark.read.schema(schema).parquet(f"{path}/{part}") for part, schema in PARTS.items()})
