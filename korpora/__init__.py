"""Korpora: explainable text-search analytics and corpus processing on PySpark.

Every operator takes DataFrames and returns a DataFrame; nothing here starts a
session of its own except ``korpora.session.get_spark`` (used by tests, the
bench and scripts).
"""

__version__ = "0.1.0"
