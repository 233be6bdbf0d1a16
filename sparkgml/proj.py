"""CRS, Transformer, Geod and Proj objects with the usual Python interface to coordinate operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np

from .functions.crs import Crs
from .functions.crs_text import Compound, equivalent, from_user_input, identify, to_proj, to_projjson, to_wkt
from .functions.geodesic import line_positions, polygon_area, solve_direct, solve_inverse
from .functions.operations import Pipeline, SelectedTransform
from .functions.project import ELLIPSOIDS, ProjectionError, projection


class CRS:
    """A CRS of anything that from_user_input() takes."""

    def __init__(self, given: Any):
        self.crs: Crs | Compound = given.crs if isinstance(given, CRS) else from_user_input(given)
        self.horizontal: Crs = self.crs.horizontal if isinstance(self.crs, Compound) else self.crs

    @classmethod
    def from_epsg(cls, code: int) -> CRS:
        return cls(int(code))

    @classmethod
    def from_user_input(cls, given: Any) -> CRS:
        return cls(given)

    from_string = from_wkt = from_proj4 = from_json = from_user_input

    @property
    def name(self) -> str:
        return self.crs.name

    @property
    def is_geographic(self) -> bool:
        return self.horizontal.geographic

    @property
    def is_projected(self) -> bool:
        return not self.horizontal.geographic

    @property
    def is_compound(self) -> bool:
        return isinstance(self.crs, Compound)

    @property
    def area_of_use(self) -> tuple[float, float, float, float]:
        return self.horizontal.area

    @property
    def axis_directions(self) -> list[str]:
        return ["north", "east"] if self.horizontal.first_axis == "N" else ["east", "north"]

    @property
    def ellipsoid(self) -> tuple[float, float]:
        """Semi-major axis and inverse flattening."""
        return ELLIPSOIDS[self.horizontal.ellipsoid]

    def to_epsg(self) -> int | None:
        found = [] if self.is_compound else identify(self.horizontal)
        return found[0] if found and found[0] > 0 else None

    def to_authority(self) -> tuple[str, str] | None:
        if self.horizontal.code == -84:
            return "OGC", "CRS84"
        code = self.to_epsg()
        return None if code is None else ("EPSG", str(code))

    def to_wkt(self, version: int = 2) -> str:
        return to_wkt(self.horizontal, version)

    def to_proj4(self) -> str:
        return to_proj(self.horizontal)

    def to_json_dict(self) -> dict[str, Any]:
        return to_projjson(self.horizontal)

    def equals(self, other: Any, ignore_axis_order: bool = False) -> bool:
        return equivalent(self.crs, CRS(other).crs, not ignore_axis_order)

    def __eq__(self, other: object) -> bool:
        try:
            return self.equals(other)
        except (ProjectionError, TypeError, AttributeError):
            return NotImplemented

    def __hash__(self) -> int:
        return hash((self.horizontal.datum, self.horizontal.geographic))

    def __repr__(self) -> str:
        return f"<CRS {self.name}>"


class Transformer:
    """Between two CRSs in the order of their axes, or easting first with always_xy; or a pipeline."""

    def __init__(self, run, source: Crs | None = None, target: Crs | None = None, always_xy: bool = True):
        self.run, self.source, self.target, self.always_xy = run, source, target, always_xy

    @classmethod
    def from_crs(cls, source: Any, target: Any, always_xy: bool = False, area_of_interest: tuple[float, float, float, float] | None = None) -> Transformer:
        run = SelectedTransform(CRS(source).horizontal, CRS(target).horizontal, area=area_of_interest)
        return cls(run, run.source, run.target, always_xy)

    @classmethod
    def from_pipeline(cls, text: str) -> Transformer:
        return cls(Pipeline(text))

    @property
    def description(self) -> str:
        return self.run.text if isinstance(self.run, Pipeline) else str(self.run.candidates[0])

    def transform(self, x, y, z=None, *, inverse: bool = False):
        if isinstance(self.run, Pipeline):
            out = self.run.convert(x, y, 0.0 if z is None else z, inverse=inverse)[: 2 if z is None else 3]
        else:
            run = SelectedTransform(self.target, self.source) if inverse else self.run
            turned = lambda crs: not self.always_xy and crs.first_axis == "N"
            if turned(run.source):
                x, y = y, x
            out = run.convert(x, y, z)
            if turned(run.target):
                out = (out[1], out[0], *out[2:])
        return tuple(float(v) if np.ndim(v) == 0 else v for v in out)

    def itransform(self, points: Iterable[tuple[float, ...]]) -> Iterator[tuple[float, ...]]:
        rows = list(points)
        yield from zip(*(np.asarray(v).tolist() for v in self.transform(*map(np.array, zip(*rows, strict=True)))), strict=True) if rows else ()


class TransformerGroup:
    """All operations between two CRSs, the best first."""

    def __init__(self, source: Any, target: Any, always_xy: bool = False, area_of_interest: tuple[float, float, float, float] | None = None):
        best = SelectedTransform(CRS(source).horizontal, CRS(target).horizontal, area=area_of_interest)
        self.transformers = []
        for c in best.candidates:
            one = SelectedTransform(best.source, best.target, area=area_of_interest, per_point=False)
            one.candidates = [c]
            self.transformers.append(Transformer(one, one.source, one.target, always_xy))

    @property
    def accuracies(self) -> list[float]:
        return [t.run.candidates[0].accuracy for t in self.transformers]


class Geod:
    """Geodesics on an ellipsoid, degrees and metres."""

    def __init__(self, ellps: str = "WGS84", a: float | None = None, rf: float = 0.0):
        self.shape = (a, rf) if a else ellps

    def inv(self, lon1, lat1, lon2, lat2):
        """Azimuth at 1, azimuth back at 2, distance."""
        az1, az2, s, _ = solve_inverse(lon1, lat1, lon2, lat2, self.shape)
        return az1, (az2 + 360) % 360 - 180, s

    def fwd(self, lon, lat, az, distance):
        lon2, lat2, az2 = solve_direct(lon, lat, az, distance, self.shape)
        return lon2, lat2, (az2 + 360) % 360 - 180

    def npts(self, lon1: float, lat1: float, lon2: float, lat2: float, n: int) -> list[tuple[float, float]]:
        lon, lat = line_positions(lon1, lat1, lon2, lat2, n, self.shape)
        return list(zip(lon.tolist(), lat.tolist(), strict=True))

    def line_lengths(self, lon, lat) -> np.ndarray:
        lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        return solve_inverse(lon[:-1], lat[:-1], lon[1:], lat[1:], self.shape)[2]

    def line_length(self, lon, lat) -> float:
        return float(self.line_lengths(lon, lat).sum())

    def polygon_area_perimeter(self, lon, lat) -> tuple[float, float]:
        return polygon_area(lon, lat, self.shape)


class Proj:
    """A projection: calling it gives easting and northing, with inverse=True longitude and latitude."""

    def __init__(self, given: Any):
        self.crs = CRS(given)
        self.pair = None if self.crs.is_geographic else projection(self.crs.horizontal)

    def __call__(self, x, y, inverse: bool = False):
        out = (x, y) if self.pair is None else self.pair[inverse](np.asarray(x, float), np.asarray(y, float))
        return tuple(float(v) if np.ndim(v) == 0 else v for v in out)
