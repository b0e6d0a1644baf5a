"""Join discovery and data-lake integration on Spark.

Profiles every column of a directory of tables, scores column pairs as join
candidates, picks a minimal join tree, repairs keys with validated, versioned
transformations, and builds the joined result and reporting layers.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers go by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
