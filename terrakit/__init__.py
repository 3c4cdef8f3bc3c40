"""terrakit: national geographic data work as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a cluster needs no
# copy of the package and the driver may start anywhere.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
