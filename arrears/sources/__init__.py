"""Source relations: schemas, readers, sinks and driver-table adapters."""

from arrears.sources.catalog import DriverSources, TableSources, Sources  # noqa: F401
