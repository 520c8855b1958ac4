"""Tensors and the concepts they respond to, as Spark DataFrames.

Every operator is an ordinary function ``DataFrame -> DataFrame`` and can be
chained with ``df.transform``.
"""

from unitscope import schema
from unitscope.session import checkpoint_dir, cut, get_session, scratch

__all__ = ["checkpoint_dir", "cut", "get_session", "schema", "scratch"]
