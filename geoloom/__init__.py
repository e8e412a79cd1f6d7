"""Earth-observation analytics as DataFrame-to-DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of an installed package are sent to Python workers by name, and a
# worker that cannot import the package fails. Sent by value they run anywhere,
# in the process that sets up a streaming processor too.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
