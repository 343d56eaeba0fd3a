"""Spark data sources of voxels from raw image stacks: .npy files of shape (z, y, x), (channel, z, y, x) or
(time, channel, z, y, x), each a scene of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Voxels of one Arrow batch, about.
BATCH = 1 << 18
KEYS = ("image_id", "scene", "channel", "time", "z")


class PlanePartition(InputPartition):
    def __init__(self, path: str, key: tuple[int, ...]):
        self.path, self.key = path, key


class VoxelReader(DataSourceReader):
    """One partition for each plane that is asked for by options: a plane is read alone, and a stack never whole; other
    planes are not opened."""

    def __init__(self, options: dict, dense: bool):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.dense = dense
        self.wanted = {k: {int(v) for v in options[k].split(",")} for k in KEYS if options.get(k)}

    def partitions(self) -> list[InputPartition]:
        found = []
        for image, path in enumerate(self.paths):
            shape = (1, 1, *np.load(path, mmap_mode="r").shape)[-5:]
            if len(shape) != 5 or len(np.load(path, mmap_mode="r").shape) < 3:
                raise ValueError(f"{path} is no stack of planes")
            for key in ((image, image, c, t, z) for t in range(shape[0]) for c in range(shape[1]) for z in range(shape[2])):
                if all(v in self.wanted.get(k, (v,)) for k, v in zip(KEYS, key, strict=True)):
                    found.append(PlanePartition(path, key))
        return found

    def read(self, partition: PlanePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        image, scene, channel, time, z = partition.key
        stack = np.load(partition.path, mmap_mode="r")
        plane = stack.reshape((1,) * (5 - stack.ndim) + stack.shape)[time, channel, z]
        rows = max(1, BATCH // max(1, plane.shape[1]))
        for top in range(0, plane.shape[0], rows):
            part = np.asarray(plane[top : top + rows], float)
            ys, xs = np.indices(part.shape) if self.dense else np.nonzero(part)
            ys, xs = ys.ravel(), xs.ravel()
            n = lambda v, kind=np.int32: pa.array(np.full(len(ys), v, kind))
            at = [pa.array((ys + top).astype(np.int32)), pa.array(xs.astype(np.int32)), pa.array(part[ys, xs])]
            key = [n(image), n(scene), n(channel), n(time), n(z)] if self.dense else [n(image), n(z)]
            names = [*KEYS, "y", "x", "v"] if self.dense else ["image_id", "z", "y", "x", "v"]
            yield pa.RecordBatch.from_arrays([*key, *at], names)


class FilteredReader(VoxelReader):
    """Takes filters on the keys of planes too. Spark accepts such a reader only where it hands filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name in KEYS:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f


class VoxelSource(DataSource):
    """spark.dataSource.register(VoxelSource); spark.read.format("voxels").option("paths", ...). Zero is padding and is left
    out; for a mean over planes, in which zeros count, read ``PlaneSource``."""

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def schema(self) -> str:
        return "image_id int, z int, y int, x int, v double"

    def reader(self, schema) -> DataSourceReader:
        return VoxelReader(self.options, False)


class PlaneSource(DataSource):
    """spark.dataSource.register(PlaneSource); spark.read.format("planes").option("paths", ...): every voxel, zeros too. The options
    image_id, scene, channel, time and z name what to read (numbers with commas between). With the option pushdown=true filters
    on these columns do so too; it needs spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "planes"

    def schema(self) -> str:
        return ", ".join(f"{k} int" for k in (*KEYS, "y", "x")) + ", v double"

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else VoxelReader)(self.options, True)
