"""lociweave: gene co-expression network analytics as Spark query plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of the package: its functions travel with the plans that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
