"""Operators for large training-data pipelines.

Functions that run on executors travel by value, so that executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
