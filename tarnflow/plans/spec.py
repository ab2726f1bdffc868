"""Model settings: named choices by name or number, checks that report everything at once, JSON round trip."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

#: Choices of the named settings, in the order of their numbers.
CHOICES = {
    "scheme": ("kinematic", "diffusive", "muskingum", "dynamic", "implicit"),
    "weights": ("thiessen", "idw"),
    "runoff": ("none", "coefficient", "raster", "scs_cn", "physical"),
    "infiltration": ("none", "green_ampt"),
    "saturation": ("none", "vsa"),
}


@dataclass
class ModelSpec:
    scheme: str = "kinematic"
    weights: str = "thiessen"
    runoff: str = "scs_cn"
    infiltration: str = "none"
    saturation: str = "none"
    cell_size: float = 30.0
    dt: float = 60.0
    output_interval: float = 3600.0
    min_slope: float = 1e-4
    idw_power: float = 2.0
    abstraction_ratio: float = 0.2

    def __setattr__(self, name: str, value) -> None:
        if name not in {f.name for f in fields(self)}:
            raise AttributeError(f"no setting {name}")
        if name in CHOICES:
            options = CHOICES[name]
            if isinstance(value, int) and not isinstance(value, bool):
                if not 0 <= value < len(options):
                    raise ValueError(f"{name} is a number from 0 to {len(options) - 1}")
                value = options[value]
            value = str(value).strip().lower()
            if value not in options:
                raise ValueError(f"{name} is one of {', '.join(options)}")
        super().__setattr__(name, value)

    def problems(self) -> list[str]:
        """Everything that is wrong, not only the first."""
        out = [f"{n} must be above zero" for n in ("cell_size", "dt", "output_interval", "min_slope", "idw_power") if not getattr(self, n) > 0]
        if self.output_interval < self.dt:
            out.append("output_interval is shorter than dt")
        if not 0 <= self.abstraction_ratio <= 1:
            out.append("abstraction_ratio lies between 0 and 1")
        if self.runoff != "physical" and (self.infiltration, self.saturation) != ("none", "none"):
            out.append("mechanisms need the physical runoff mode")
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ModelSpec:
        return cls(**json.loads(text))
