"""plumbline: a Spark-first engine that checks answers against their sources.

The package is pickled by value for Python workers, so executors need no copy
of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
