"""Operators of a training-data pipeline: ten text operators and their queries.

Nothing outside this package imports it.  Functions that run on executors are
pickled by value, so workers need no copy of the package on their path.
"""

from pyspark import cloudpickle

import ripplebed

cloudpickle.register_pickle_by_value(ripplebed)
