"""Repository-health analytics as Spark jobs.

Every operator takes DataFrames keyed by ``repo`` and returns a DataFrame, so
one job measures every repository of an organisation at once.
"""

from tidemark.session import build_session

__all__ = ["build_session"]
