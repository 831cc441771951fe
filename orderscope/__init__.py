"""orderscope: procurement analytics and retrieval on Spark."""

import sys as _sys

# Functions of this package that run in Python workers (pandas UDFs,
# mapInPandas/applyInPandas bodies) are pickled by value, so executors need
# no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship the package with --py-files instead
    pass
