"""Helpers for tests built on hand-made rows."""

from arrears.sources.catalog import Sources
from arrears.sources.schemas import struct


class RowSources(Sources):
    """Sources from in-memory rows (dict relation -> list of tuples) typed
    by the declared schemas; relations not given are empty."""

    def __init__(self, spark, rows: dict):
        super().__init__(spark)
        self._rows = rows

    def _load(self, name):
        return self.spark.createDataFrame(self._rows.get(name, []), struct(name))


def by(rows, key):
    return {r[key]: r for r in rows}
