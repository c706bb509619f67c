"""Event-segmented, multichannel time series on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors with the job, so the package need not be
# installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
