"""Strandline: analytics and training-data operators expressed as Spark plans.

Functions that run in Python workers are shipped by value, so executors need
nothing of this package installed.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
