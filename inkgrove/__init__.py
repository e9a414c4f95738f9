"""inkgrove: retrieval, link-graph and text-data processing over collections of notes, on Spark.

Layout: ``sources`` (readers), ``functions`` (column expressions and row functions), ``operators``
(DataFrame in, DataFrame out), ``plans`` (registered queries and their SQL twins), ``streaming``
(append-only feeds), ``llm`` (operators for training data; nothing else imports it).
"""

from inkgrove.config import EngineConfig

__all__ = ["EngineConfig"]
