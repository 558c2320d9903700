"""gridloom: labelled N-D arrays as Spark tables, and back."""

import sys

from pyspark import cloudpickle

# functions travel to the workers by value, so that executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
