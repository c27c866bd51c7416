"""The driver's tables seen as retrieval data, the checked queries, and their SQL."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
