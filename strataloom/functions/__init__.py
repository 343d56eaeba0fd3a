"""Column expressions: coordinates, boxes, tiles, shapes."""
