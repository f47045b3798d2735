"""condmon: machine-condition analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few grouped functions travel to the workers whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
