"""Region-of-interest analytics over collections of two-dimensional images, on Spark.

Every operator takes DataFrames keyed by ``(session, y, x)`` or ``(session, label)``
and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# the small task-side helpers travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
