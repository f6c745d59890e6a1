"""clickloom: clickstream and ad-conversion analytics as Spark DataFrame and
Structured Streaming operators."""

import sys as _sys

try:  # ship our Python helpers (pandas UDF bodies) by value to the workers
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
