"""Operators for preparing language-model training corpora.

Functions that run inside Python workers are shipped by value, so executors
need the third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
