"""Operators for preparing language-model training data.

Functions of this package run inside Spark's Python workers, so the package is
pickled by value: a worker need not have it on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
