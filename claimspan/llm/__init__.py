"""Operators for preparing training text; nothing outside this subpackage imports it.

What tasks run is sent to them by value, so that executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
