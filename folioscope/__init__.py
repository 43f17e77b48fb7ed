"""folioscope: document analytics, hybrid search and retrieval evaluation on Spark.

Every operator is a function from DataFrame(s) to a DataFrame.  Operators are
lazy unless their docstring says that they run a (small) job.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
