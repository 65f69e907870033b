"""envmon: Spark-native analytics for environmental monitoring tables.

Operators take DataFrames (a mapping of table name -> DataFrame) and return
DataFrames; nothing is collected to the driver.  See README.md.
"""

from .session import get_session, shared_dir  # noqa: F401

__all__ = ["get_session", "shared_dir"]
