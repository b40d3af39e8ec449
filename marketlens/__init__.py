"""marketlens — a Spark-native layered retail warehouse and report library.

Raw order tables become a detail fact, daily / weekly / category / state
marts and report DataFrames.  Every step is a DataFrame transformation that
Catalyst plans; nothing is pulled through the driver.
"""

from marketlens.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
