"""Sources and sinks: typed application scans, year slices, report and model writers."""

from equiloan.sources.applications import (  # noqa: F401
    APPLICATION_SCHEMA,
    read_applications,
    read_columns,
    year_slice,
)
from equiloan.sources.sinks import load_model, save_model, write_prepared, write_report  # noqa: F401
from equiloan.sources.standin import stand_in_applications  # noqa: F401
