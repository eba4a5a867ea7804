"""Operators for building training corpora, each with the query that applies it to its whole table.

Functions that run on executors are shipped by value, so the workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
