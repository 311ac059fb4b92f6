"""strandlake: sequence, variant and quantitative-genetics analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Workers get the library's functions by value, so that the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
