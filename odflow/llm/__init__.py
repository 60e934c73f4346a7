"""Training-data operators: deduplication, decontamination, licences, sharding, chat repair,
mixing, URL rules, WARC derivatives and toxicity.  Nothing else in the library imports this
subpackage.  Every operator selects the columns it is told about (``id_col``, ``text_col``,
...), so extra columns of its input, whatever their names, are neither read nor clash.
"""

import sys

from pyspark import cloudpickle

# Task code is shipped by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
