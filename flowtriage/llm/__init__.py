"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code: those need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
