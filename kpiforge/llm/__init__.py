"""Operators for preparing large text corpora for model training.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Code that runs in Python workers travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
