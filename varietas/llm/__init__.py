"""Training-data pipeline operators (quality, near-duplicates, personal data, rules, decontamination,
token files, mixing, sharding, toxicity, language) and their registered queries.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of this subpackage, the corpus pipeline included."""
    from varietas.llm import queries
    return queries.all_queries()
