"""filinglens: filing analytics as PySpark DataFrame jobs."""

from pyspark import cloudpickle as _cloudpickle

from . import functions, operators, plans, sources, streaming  # noqa: F401

# Task functions travel inside the job, so executors need no installed copy.
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
