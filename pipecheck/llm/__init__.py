"""Operations of a training-data pipeline over documents, pages and labels.

Nothing else in the library imports this package. Its functions are sent to the
Python workers by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
