"""Analytics over the operational data of a backup client, on Spark's own operators."""

import sys

from pyspark import cloudpickle

# Python functions and data sources of this package travel to the executors with the plan; nothing is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
