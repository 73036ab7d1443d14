"""kassa: cleaning and KPI analytics of retail transactions on Spark.

Every stage is a lazy ``DataFrame -> DataFrame`` function built from Spark's
own expressions; see ``kassa.plans.run`` for the end-to-end job.
"""

from kassa.config import DEFAULT, CleanConfig
from kassa.plans.run import run_pipeline
from kassa.plans.stages import cleaned, enriched, flag, thresholds

__all__ = ["CleanConfig", "DEFAULT", "cleaned", "enriched", "flag", "run_pipeline",
           "thresholds"]
