"""Training-data operators (quality, dedup, decontamination, mixing, ...).

What runs inside tasks is sent along with the job, so workers need not have
this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
