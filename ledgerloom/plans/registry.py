"""All registered queries of the reconciliation operators, with the SQL that gives the same rows."""

from . import checks, completeness, covers, documents, extraction, inspection, matching, outputs, records, reports, scoring, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (completeness, records, matching, texts, extraction, reports, scoring, documents, checks, covers, outputs, inspection):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
FLAGSHIP = "role_complete"
