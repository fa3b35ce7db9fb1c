"""All queries: importing this module registers them. Operators import the registry alone, so that a task can import any of
them on its own."""

from quillmill.operators import analytics, conversation, evaluation, goldset, graph, incremental, inverted_index, relational, retrieval, supplementary, textual, upkeep, vector_index  # noqa: F401
from quillmill.registry import ORACLE_SQL, QUERIES  # noqa: F401
from quillmill.streaming import queries, sessions, sync  # noqa: F401
