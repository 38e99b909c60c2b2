"""Operators of a training-data pipeline.

Nothing else in the library imports this package.  Its functions travel to the workers by
value, so executors need no package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
