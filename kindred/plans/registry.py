"""All registered queries outside `kindred.llm`, and their SQL."""

from __future__ import annotations

from kindred.plans import domains, measures, records, suites, words

QUERIES = {**domains.QUERIES, **words.QUERIES, **measures.QUERIES, **suites.QUERIES, **records.QUERIES}
SQL = {**domains.SQL, **words.SQL, **measures.SQL, **suites.SQL, **records.SQL}
