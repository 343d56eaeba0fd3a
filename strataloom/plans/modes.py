"""Planning modes: output, grouping, z and optimisation choices, their keys, labels and descriptions."""

from __future__ import annotations

from dataclasses import dataclass

#: The choices of each part of a planning key, with their labels. Saved plans hold the keys.
OUTPUTS = {"detection_points": "Detection points", "group_center_points": "Group center points", "tile_point_grid": "Tile point grid", "rectangular_regions": "Rectangular tile scans", "polygon_regions": "Polygon mosaics"}
GROUPINGS = {"none": "None", "xy": "XY", "xy_z": "XY and Z"}
Z_MODES = {"overview": "Overview Z", "per_roi": "Per ROI Z", "per_tile": "Per tile Z"}
OPTIMISATIONS = {"direct": "Direct", "tile_count": "Tile-count optimized"}
PREFIX = "custom:"
DEFAULT = "custom:polygon_regions|xy_z|per_roi|tile_count"

PARTS = (("output", OUTPUTS), ("grouping", GROUPINGS), ("z", Z_MODES), ("optimisation", OPTIMISATIONS))
TITLES = {"output": "Output", "grouping": "Grouping", "z": "Z handling", "optimisation": "Optimization"}


@dataclass(frozen=True)
class Mode:
    output: str
    grouping: str
    z: str
    optimisation: str

    def __post_init__(self):
        for name, choices in PARTS:
            if getattr(self, name) not in choices:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; known: {', '.join(choices)}")
        if self.z == "per_tile" and self.output != "tile_point_grid":
            raise ValueError("z per tile is for tile point grids only")

    @property
    def key(self) -> str:
        return PREFIX + "|".join((self.output, self.grouping, self.z, self.optimisation))

    @property
    def labels(self) -> dict[str, str]:
        return {name: choices[getattr(self, name)] for name, choices in PARTS}

    @property
    def label(self) -> str:
        return ", ".join(self.labels.values())

    @property
    def needs_z(self) -> bool:
        return self.z != "overview" or self.grouping == "xy_z"

    @property
    def speed(self) -> str:
        """What to expect of large selections."""
        slow = [why for on, why in ((self.optimisation == "tile_count", "the search for few tiles"), (self.output == "polygon_regions", "drawing polygons")) if on]
        return "slower for large selections by " + " and ".join(slow) if slow else "quick"

    @property
    def tooltip(self) -> str:
        """One line for each choice, after the label."""
        return "\n".join([self.label, "", *(f"{TITLES[name]}: {text}" for name, text in self.labels.items()), f"Speed: {self.speed}"])


def parse(key: str | None) -> Mode:
    """The mode of a key; an empty one is the default."""
    key = (key or DEFAULT).strip()
    parts = key.removeprefix(PREFIX).split("|")
    if not key.startswith(PREFIX) or len(parts) != len(PARTS):
        raise ValueError(f"not a planning key: {key!r}")
    return Mode(*parts)


def help_text() -> str:
    """All choices by part, with their keys."""
    return "\n\n".join("\n".join([TITLES[name], *(f"  {key}: {text}" for key, text in choices.items())]) for name, choices in PARTS)


def by_label(part: str, label: str) -> str:
    """Key of a choice from its label, or from the key itself."""
    choices = dict(PARTS)[part]
    for key, text in choices.items():
        if label in (key, text):
            return key
    raise ValueError(f"unknown {part} {label!r}")


def distinct(keys: list[str]) -> list[str]:
    """Keys without repetitions, in the order of their first places."""
    return list(dict.fromkeys(parse(k).key for k in keys))
