"""Plans of the engine: the registered queries."""

from veridoc.plans import assembly_queries, corpus_queries, governance_queries, more_queries, queries  # noqa: F401
