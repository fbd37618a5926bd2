"""Colours of layer values as Column expressions: (r, g, b) from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfmesh.functions.geom import clamp01

Rgb = tuple[Column, Column, Column]


def hsv2rgb(h: Column, s: Column, v: Column) -> Rgb:
    """The standard six sectors; h in degrees."""
    c = v * s
    sector = F.pmod(h, F.lit(360.0)) / 60.0
    x = c * (1.0 - F.abs(F.pmod(sector, F.lit(2.0)) - 1.0))
    m, zero = v - c, F.lit(0.0)

    def channel(*by_sector: Column) -> Column:
        out = by_sector[5]
        for k in range(4, -1, -1):
            out = F.when(sector < k + 1, by_sector[k]).otherwise(out)
        return out + m

    return channel(c, x, zero, zero, x, c), channel(x, c, c, x, zero, zero), channel(zero, zero, x, c, c, x)


def _where(cond: Column, yes: tuple[float, float, float], no: Rgb) -> Rgb:
    return tuple(F.when(cond, F.lit(y)).otherwise(n) for y, n in zip(yes, no, strict=True))


def color_u8(v: Column) -> Rgb:
    """0 white, 255 dark grey, 254 black, else a grey that darkens."""
    grey = F.when(v == 0, 1.0).when(v == 255, 0.25).when(v == 254, 0.0).otherwise(1.0 - v / F.lit(253.0))
    return grey, grey, grey


def _share(v: Column, top: Column) -> Column:
    return F.when(F.isnan(v), F.lit(1.0)).otherwise(clamp01(v / F.when(top > 1e-9, top)))


def color_heat(v: Column, top: Column) -> Rgb:
    """Green to red; all green where the top value is 0. NaN counts as the top."""
    t = _share(v.cast("double"), top.cast("double"))
    return _where(top <= 1e-9, (0.0, 1.0, 0.0), (t, 1.0 - t, F.lit(0.0)))


def color_rainbow(v: Column, top: Column) -> Rgb:
    """Blue (low) to red (top); all green where the top value is 0. NaN counts as the top."""
    hue = (1.0 - _share(v.cast("double"), top.cast("double"))) * 240.0
    return _where(top <= 1e-9, (0.0, 1.0, 0.0), hsv2rgb(hue, F.lit(1.0), F.lit(1.0)))
