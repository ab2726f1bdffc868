"""Open-channel expressions: Manning flow, compound sections, normal depth, wave speeds, limiters, Muskingum-Cunge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hydraulic geometry, width and depth in m from area in km2 (factor, power).
REGIONS = {
    "usa": (2.70, 0.352, 0.30, 0.213), "laurentian_upland": (4.15, 0.308, 0.31, 0.202), "atlantic_plain": (2.22, 0.363, 0.24, 0.323),
    "appalachian_highlands": (3.12, 0.415, 0.26, 0.287), "interior_plains": (2.56, 0.351, 0.38, 0.191), "interior_highlands": (23.23, 0.121, 0.27, 0.267),
    "rocky_mountains": (1.24, 0.435, 0.23, 0.225), "intermontane_plateaus": (1.11, 0.415, 0.07, 0.329), "pacific_mountains": (2.76, 0.399, 0.23, 0.294),
}


def geometry(area_km2: Column, region: str) -> tuple[Column, Column]:
    wa, wb, da, db = REGIONS[region]
    area = F.greatest(area_km2, F.lit(1e-6))
    return wa * F.pow(area, F.lit(wb)), da * F.pow(area, F.lit(db))


def sheet_velocity(h: Column, s: Column, n: Column) -> Column:
    return F.pow(h, F.lit(2 / 3)) * F.sqrt(s) / n


def sheet_flow(h: Column, s: Column, n: Column, width: Column) -> Column:
    return sheet_velocity(h, s, n) * width * h


def channel_flow(h: Column, s: Column, n: Column, width: Column) -> Column:
    area = width * h
    return F.pow(area / (width + 2 * h), F.lit(2 / 3)) * F.sqrt(s) / n * area


def conveyance(h: Column, n: Column, width: Column, bank: Column, size: Column, plain_n: Column) -> tuple[Column, Column]:
    """Conveyance and area of a slot with a floodplain sheet above its banks."""
    h = F.greatest(h, F.lit(0.0))
    over, aside = F.greatest(h - bank, F.lit(0.0)), F.greatest(size - width, F.lit(0.0))
    area = width * h
    radius = area / F.greatest(width + 2 * F.least(h, bank), F.lit(1e-12))
    return area * F.pow(radius, F.lit(2 / 3)) / n + aside * F.pow(over, F.lit(5 / 3)) / plain_n, area + aside * over


def stage(volume: Column, slot: Column, bank: Column, cell: Column) -> Column:
    full = slot * bank
    return F.when(volume <= full, volume / slot).otherwise(bank + (volume - full) / cell)


def volume(h: Column, slot: Column, bank: Column, cell: Column) -> Column:
    return F.when(h <= bank, h * slot).otherwise(bank * slot + (h - bank) * cell)


def normal_depth(q: Column, s: Column, n: Column, width: Column, rounds: int = 30) -> Column:
    """Newton's rule on the rectangular section, as a fold over the rounds; starts at the wide-channel depth."""
    start = F.pow(q * n / (F.sqrt(s) * width), F.lit(0.6))

    def step(h: Column, _: Column) -> Column:
        now = channel_flow(h, s, n, width)
        slope = now * (5 / (3 * h) - 4 / (3 * (width + 2 * h)))
        return F.greatest(h - (now - q) / slope, F.lit(1e-6))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def water_slope(bed: Column, h: Column, below: Column, dist: Column, theta: float) -> Column:
    """Water-surface slope, at least zero; the bed's where nothing lies below."""
    return F.when(below.isNull(), bed).otherwise(F.greatest(bed + theta * (h - below) / dist, F.lit(0.0)))


def diffusive_depth(h: Column, below: Column, z: Column, z_below: Column, theta: float, least: float) -> Column:
    """Conveyance depth between the cell's own and the one over the higher bed."""
    over = F.greatest(z + h, z_below + below) - F.greatest(z, z_below)
    return F.when(below.isNull(), h).otherwise(F.greatest((1 - theta) * h + theta * over, F.lit(least)))


def inertial(q: Column, q_up: Column, q_down: Column, h: Column, s: Column, n: Column, dt: float, theta: float = 0.9) -> Column:
    """Local-inertial momentum per width, centred by theta, with implicit friction."""
    centred = theta * q + (1 - theta) / 2 * (q_up + q_down)
    return (centred + 9.81 * h * dt * s) / (1 + 9.81 * dt * n * n * F.abs(q) / F.pow(h, F.lit(7 / 3)))


def limited(q: Column, stored: Column, dt: float) -> Column:
    return F.least(q, F.greatest(stored, F.lit(0.0)) / dt)


def muskingum_cunge(c: Column, area: Column, width: Column, s: Column, dist: Column, dt: float) -> dict[str, Column]:
    """Coefficients from Courant number and grid Peclet number; those of flows add up to one."""
    courant = c * dt / dist
    peclet = 0.6 * (area / F.greatest(width, F.lit(1e-30))) / (s * dist)
    under = 1 + courant + peclet
    return {"c0": (courant + peclet - 1) / under, "c1": (1 + courant - peclet) / under, "c2": (1 - courant + peclet) / under, "c3": 2 * courant / under}


def courant_step(size: float, q: Column, area: Column, number: float = 0.7) -> Column:
    """Largest time step of a cell: the number by its length over five thirds of the speed."""
    return number * size / F.greatest(5 / 3 * q / F.greatest(area, F.lit(1e-12)), F.lit(1e-12))
