"""Crowd-label aggregation on Spark DataFrames.

Long-form annotation tables ``(task_id, worker_id, label)`` go in; trusted
labels, worker reliability and quality reports come out.  Every operator is a
DataFrame -> DataFrame function; the package never needs a dense task x worker
matrix and never collects an annotation table.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions handed to Arrow operators travel by value, so executors need no copy
# of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
