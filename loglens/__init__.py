"""loglens: log analytics as PySpark DataFrames and streams."""

import sys

from pyspark import cloudpickle

from loglens.functions.parse import parse
from loglens.operators.filters import FilterSpec, Pattern
from loglens.operators.ratelimit import RateLimit, rate_limit
from loglens.plans.collector import CollectorConfig, collect
from loglens.sources.lines import read_existing, read_lines

# The few functions that run in Python workers travel with the job, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "CollectorConfig", "FilterSpec", "Pattern", "RateLimit",
    "collect", "parse", "rate_limit", "read_existing", "read_lines",
]
