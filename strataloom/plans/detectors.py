"""Detectors: from pixels (image_id, y, x, v) to labelled, filtered objects. Any object with ``detect`` will do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components, grouped, models, objects, raster
from ..operators.scratch import cut


@dataclass(frozen=True)
class Context:
    """What a detector is told: the image's size in pixels, the pixel size, the planes where known, and a
    choice of objects that replaces the count rule."""

    height: int
    width: int
    px_x: float = 1.0
    px_y: float = 1.0
    argmax_z: DataFrame | None = None
    z_positions: DataFrame | None = None
    choose: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Detection:
    """Pixels of the kept objects (image_id, y, x, label), the objects with their measurements, and, from a
    classifier, the class and probability of all pixels (image_id, y, x, cls, prob)."""

    labels: DataFrame
    objects: DataFrame
    classes: DataFrame | None = None

    @property
    def planning_classes(self) -> DataFrame:
        """Classes for planning: 1 on the kept objects where the detector has none."""
        if self.classes is not None:
            return self.classes
        return self.labels.select("image_id", "y", "x", F.lit(1).alias("cls"))


class Detector(Protocol):
    def detect(self, pixels: DataFrame, context: Context) -> Detection: ...


def detected(positive: DataFrame, context: Context, limits: objects.Limits, count: int, rule: str, classes: DataFrame | None = None) -> Detection:
    """Objects of positive pixels (image_id, y, x, prob): 8-connected, measured, filtered, then those that the
    context chooses, or the first ``count`` by ``rule`` (0: all)."""
    lab = cut(components.label_components(positive, context.width, 8))
    found = objects.measure(lab).join(objects.confidence(lab), ["image_id", "label"])
    kept = objects.filter_objects(found, limits, px_x=context.px_x, px_y=context.px_y)
    kept = cut(context.choose(kept) if context.choose else objects.top(kept, count, rule))
    return Detection(lab.select("image_id", "y", "x", "label").join(kept.select("image_id", "label"), ["image_id", "label"], "left_semi"), kept, classes)


@dataclass(frozen=True)
class ThresholdDetector:
    """Pixels of at least a threshold, absolute or a percentile, after an optional Gaussian filter. The count
    rule goes by area."""

    absolute: float | None = None
    percentile: float | None = 99.5
    sigma: float = 0.0
    limits: objects.Limits = field(default_factory=lambda: objects.Limits(min_area=25))
    count: int = 0

    def detect(self, pixels: DataFrame, context: Context) -> Detection:
        p = raster.smooth_image(pixels, self.sigma, context.height, context.width) if self.sigma > 0 else pixels
        on = raster.with_threshold(p, self.absolute, self.percentile).select("image_id", "y", "x", F.lit(None).cast("double").alias("prob"))
        return detected(on, context, self.limits, self.count, "area")


@dataclass(frozen=True)
class ClassifierDetector:
    """Pixels of the positive class of a model, on Gaussian, structure and variance features computed by tiles
    with a halo. ``normalise`` puts the signal peak of an image at 1 first. Without a choice of the context
    all objects within the limits stay."""

    model: object
    positive: int = 2
    sigmas: tuple[float, ...] = (1.0, 2.0)
    tile: int = 1024
    halo: int = 12
    normalise: bool = False
    limits: objects.Limits = field(default_factory=objects.Limits)

    def detect(self, pixels: DataFrame, context: Context) -> Detection:
        if self.normalise:
            from .compose import normalise

            pixels = normalise(pixels).select("image_id", "y", "x", F.col("norm").alias("v"))
        f = grouped.tiled_features(pixels, context.height, context.width, self.sigmas, self.tile, self.halo)
        c = cut(models.classify(f, self.model, self.positive))
        on = c.where(F.col("cls") == self.positive).select("image_id", "y", "x", "prob")
        return detected(on, context, self.limits, 0, "none", c)
