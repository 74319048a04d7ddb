"""Satellite profiles and thresholds, passed as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """A grid's axes: days since 1980-01-01 (both ends included), slots a day, cells."""

    first_day: int = 16071
    last_day: int = 16100
    slots_per_day: int = 4
    n_lat: int = 5
    n_lon: int = 5
    lat0: float = 10.0
    lat_step: float = 2.0
    lon0: float = 0.0

    @classmethod
    def square(cls, side: int) -> Profile:
        """A grid of side x side cells over the same ten degrees."""
        return cls(n_lat=side, n_lon=side, lat_step=10.0 / side)

    @property
    def days(self) -> int:
        return self.last_day - self.first_day + 1

    @property
    def hours_per_slot(self) -> int:
        return 24 // self.slots_per_day


@dataclass(frozen=True)
class Thresholds:
    # fixed values of the tests
    gross_cloud: float = 5.0
    gross_snow: float = 5.0
    cli_snow: float = 15.0
    cli_cloud: float = 10.0
    stability: float = 4.0
    cloud_epsilon: float = 0.3
    static_temperature: float = 240.0
    vis_snow: float = 0.25
    broad_vis_snow: float = 0.2
    broad_ndsi: float = 0.25
    opaque: float = 0.05
    coast: float = 0.3
    sea: float = 0.15
    ndsi: float = 0.3
    broad_cirrus: float = 0.3
    thin_cirrus: float = 10.0
    land_visible: float = 0.1
    texture: float = 2.0
    texture_rise: float = 1.5
    evolution_land: float = 5.0
    evolution_sea: float = 3.0
    evolution_pair: float = 10.0


#: fixed values: Planck, Boltzmann, speed of light
PLANCK, BOLTZMANN, LIGHT = 6.626e-34, 1.38e-23, 3.0e8
CHANNELS = ("fir", "lir", "mir", "sir", "vis")
