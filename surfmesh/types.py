"""Names, constants and options of the data model."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum


class LayerType(IntEnum):
    """The value types of a layer. The numbers are the tags of the message form."""

    U8 = 0
    F32 = 1
    F64 = 2

    @property
    def column(self) -> str:
        return ("u8", "f32", "f64")[self]

    @property
    def type_name(self) -> str:
        return ("uint8", "float", "double")[self]

    @property
    def spark_type(self) -> str:
        return ("smallint", "float", "double")[self]


class AreaShape(Enum):
    CIRCULAR = "circular"
    RECTANGULAR = "rectangular"


# Occupancy costs.
NO_INFORMATION, LETHAL_OBSTACLE, INSCRIBED, MAX_NON_OBSTACLE, FREE_SPACE = 255, 254, 253, 252, 0


@dataclass(frozen=True)
class LocateOpts:
    """Options of locate(). hint_surface and use_downward_ray are accepted and have no effect; height_eps gates the hint and the fallback
    alone, not the vertical search."""

    planar_eps: float = 1e-4
    height_eps: float = 0.5
    hint_surface: int | None = None
    use_downward_ray: bool = True


@dataclass(frozen=True)
class BuildParams:
    """Options of the point-cloud mesher. use_radius is accepted and has no effect: a neighbor_radius above 0 decides."""

    resolution: float = 1.0
    max_edge_len: float = 2.0
    max_dz: float = 0.25
    max_slope_deg: float = 30.0
    neighbor_radius: float = 2.0
    k_neighbors: int = 20
    min_area: float = 1e-6
    use_radius: bool = True
    min_angle_deg: float = 20.0
    max_surfaces: int = 0


VERTICES = "vid long, x double, y double, z double, r smallint, g smallint, b smallint, a smallint"
NAVCELS = "cid long, v0 long, v1 long, v2 long"
SURFACES = "surface_idx int, frame_id string"
SURFACE_NAVCELS = "surface_idx int, pos int, cid long"
LAYERS = "name string, type string, description string, unit string, per_cell boolean"
LAYER_VALUES = "layer string, cid long, u8 smallint, f32 float, f64 double"
