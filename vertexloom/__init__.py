"""Geospatial property graphs on PySpark: container source and sink, geometry functions, graph and data-processing operators.

Functions of this package that run on executors are shipped by value, so the executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
