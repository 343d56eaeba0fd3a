"""Operators over pixel, object, point and region tables."""
