"""Corpus operators for training data: DataFrame-in, DataFrame-out jobs.

Functions of this package that run inside Spark tasks are pickled by value, so
executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
