"""Class and source search over collections of versioned code archives, on Spark."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
