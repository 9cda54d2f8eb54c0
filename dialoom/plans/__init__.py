"""Named queries over the shared tables, each with the SQL that must give the same rows."""

from dialoom.plans import audits, chapters, curation, dialogue, production, relational, texts
from dialoom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "chapters", "curation", "dialogue", "production", "relational", "texts"]
