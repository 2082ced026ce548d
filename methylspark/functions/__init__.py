"""Column expressions and Arrow helpers.

The helpers are shipped with each job by value, so executors need no copy of
this package.
"""

from pyspark import cloudpickle

from methylspark.functions import placement, stats

cloudpickle.register_pickle_by_value(placement)
cloudpickle.register_pickle_by_value(stats)
