"""Regular lat/lon lattice: metadata on the driver, cell algebra as Columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.functions.scalar import col


@dataclass(frozen=True)
class Lattice:
    """Cell-centred axes; latitude ascends with iy."""

    lon_min: float
    lat_min: float
    nlon: int
    nlat: int
    res: float

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return (self.lon_min, self.lat_min, self.lon_min + self.nlon * self.res, self.lat_min + self.nlat * self.res)

    def coarser(self, factor: int) -> "Lattice":
        if factor < 1 or self.nlat % factor or self.nlon % factor:
            raise ValueError(f"factor {factor} does not divide the lattice")
        return replace(self, nlon=self.nlon // factor, nlat=self.nlat // factor, res=self.res * factor)

    def offsets_in(self, outer: "Lattice") -> tuple[int, int]:
        """Row and column of this lattice's first cell inside an outer one."""
        if abs(outer.res - self.res) > 1e-9:
            raise ValueError("lattices must share a resolution")
        dy = round((self.lat_min - outer.lat_min) / outer.res)
        dx = round((self.lon_min - outer.lon_min) / outer.res)
        if min(dy, dx) < 0 or dy + self.nlat > outer.nlat or dx + self.nlon > outer.nlon:
            raise ValueError("inner lattice is not contained in the outer one")
        return dy, dx

    def lat(self, iy="iy") -> Column:
        return (col(iy) + 0.5) * self.res + self.lat_min

    def lon(self, ix="ix") -> Column:
        return (col(ix) + 0.5) * self.res + self.lon_min

    def row(self, lat) -> Column:
        """Fractional row of a latitude, zero at the first centre."""
        return (col(lat) - (self.lat_min + 0.5 * self.res)) / self.res

    def column(self, lon) -> Column:
        return (col(lon) - (self.lon_min + 0.5 * self.res)) / self.res

    def contains(self, lat, lon, margin: float = 0.0) -> Column:
        lo, la, hi, ha = self.bbox
        return ((col(lon) > lo + margin) & (col(lon) < hi - margin)
                & (col(lat) > la + margin) & (col(lat) < ha - margin))

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell, generated on the executors."""
        n = spark.range(self.nlat * self.nlon)
        iy, ix = F.floor(F.col("id") / self.nlon).cast("int"), (F.col("id") % self.nlon).cast("int")
        return n.select(iy.alias("iy"), ix.alias("ix")).select(
            "iy", "ix", self.lat().alias("lat"), self.lon().alias("lon"))


# Lattice the grid view is placed on: 16 x 16 cells of 0.5 degrees.
VIEW_LATTICE = Lattice(lon_min=86.0, lat_min=20.0, nlon=16, nlat=16, res=0.5)
