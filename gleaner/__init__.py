"""gleaner: a PySpark-native engine for curating large collections of labelled items.

Python functions of this package are pickled by value, so a cluster whose
executors lack the package still runs every operator.
"""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
