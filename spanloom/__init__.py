"""Span and relation analytics over text collections, expressed as Spark DataFrame operators.

Functions that run on executors are shipped by value, so a cluster needs the third-party libraries only, not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
