"""Dataset onboarding and data-quality engine on PySpark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the task helpers with the job, so the package need not be
# installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
