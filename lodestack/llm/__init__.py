"""Training-data operators: one module for each, plus :mod:`registry`, which names their queries.

Nothing outside this subpackage imports it. Functions that run in Python workers are pickled by
value, so executors need numpy, pyarrow and the tokenizer libraries but no copy of this package.
"""

import importlib

from pyspark import cloudpickle

for _name in ("kernels", "session", "repeats", "substring", "suffix", "simhash", "toxicity", "packing", "quality", "html_extract", "ann"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
