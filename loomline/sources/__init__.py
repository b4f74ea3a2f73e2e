"""Readers and writers."""

from loomline.sources.tables import table  # noqa: F401
