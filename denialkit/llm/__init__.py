"""Training-data operators (deduplication, filtering, tokenising) as Spark jobs.

Nothing outside this subpackage imports it; see ``queries.py`` for the registered queries.
"""
