"""Operators for building language-model training corpora.

The package is shipped to executors by value, so a cluster needs no install of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
