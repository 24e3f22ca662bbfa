"""Modelling studies on large tables, expressed as Spark DataFrame jobs.

Sub-packages
------------
functions   column helpers, hashing, running totals, special functions
sources     readers, writers, model packages, report collection
operators   one function per study operation (quality, tests, splits, metrics, ranks ...)
plans       end-to-end study flows and the registered queries
streaming   scoring and quality counts on arriving rows
"""

import sys

from pyspark import cloudpickle

from studyframe.session import study_session

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["study_session"]
