"""Operators for preparing training text at scale. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# The package travels with its functions, so that Python workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
