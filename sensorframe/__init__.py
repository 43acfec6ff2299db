"""Sensor-log analytics on PySpark."""

import sys

from pyspark import cloudpickle

from .functions import (
    epoch_ms,
    epoch_us,
    format_ts,
    from_epoch,
    hex_id,
    identifier_range_label,
    parse_ts,
)
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import SeriesSpec, series_bundle, table_view
from .scratch import release_pinned
from .sinks import export_view, write_export
from .sources import *  # noqa: F403
from .sources import __all__ as _sources
from .streaming import *  # noqa: F403
from .streaming import __all__ as _streaming

# The few batch functions that run in Python workers travel with the job, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "SeriesSpec",
    "epoch_ms",
    "epoch_us",
    "export_view",
    "format_ts",
    "from_epoch",
    "hex_id",
    "identifier_range_label",
    "parse_ts",
    "release_pinned",
    "series_bundle",
    "table_view",
    "write_export",
    *_operators,
    *_sources,
    *_streaming,
]
