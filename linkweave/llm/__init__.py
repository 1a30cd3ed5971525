"""Operators for preparing training text: filtering, deduplication, search and tokenizing, on PySpark DataFrames.

Functions that run inside tasks travel by value, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
