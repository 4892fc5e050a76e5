"""Filter chains: a JSON list of steps, made into one lazy plan. Channels are whole numbers again after every step."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import neighbor, point

#: Step name to the operator and its parameters' names (none: a bare name; one: a bare value).
STEPS = {
    "Brightness": (point.brightness, ("amount",)),
    "Contrast": (point.contrast, ("factor",)),
    "Saturate": (point.saturate, ("factor",)),
    "WhiteBalance": (point.white_balance, ("temperature",)),
    "Grayscale": (point.grayscale, ()),
    "Sepia": (point.sepia, ()),
    "Invert": (point.invert, ()),
    "HueRotate": (point.hue_rotate, ("degrees",)),
    "GaussianBlur": (neighbor.gaussian_blur, ("sigma",)),
    "Sharpen": (neighbor.sharpen, ("sigma", "threshold")),
}


@dataclass
class FilterChain:
    steps: list[tuple[str, tuple]] = field(default_factory=list)

    def push(self, name: str, *values) -> FilterChain:
        if name not in STEPS:
            raise ValueError(f"unknown filter {name}")
        if len(values) != len(STEPS[name][1]):
            raise ValueError(f"{name} takes {len(STEPS[name][1])} values")
        self.steps.append((name, values))
        return self

    def __len__(self) -> int:
        return len(self.steps)

    def is_empty(self) -> bool:
        return not self.steps

    def to_json(self) -> str:
        def one(name, values):
            names = STEPS[name][1]
            return name if not names else {name: values[0] if len(names) == 1 else dict(zip(names, values, strict=True))}

        return json.dumps({"steps": [one(*s) for s in self.steps]})

    @classmethod
    def from_json(cls, text: str) -> FilterChain:
        chain = cls()
        for step in json.loads(text)["steps"]:
            if isinstance(step, str):
                chain.push(step)
            else:
                ((name, value),) = step.items()
                chain.push(name, *([value[k] for k in STEPS[name][1]] if isinstance(value, dict) else [value]))
        return chain

    def apply(self, pixels: DataFrame) -> DataFrame:
        return reduce(lambda df, step: STEPS[step[0]][0](df, *step[1]), self.steps, pixels)
