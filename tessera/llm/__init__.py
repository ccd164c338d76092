"""Training-data operators: deduplication, scanning, packing, counting, scoring, quality, toxicity, sharding.

Nothing outside this subpackage imports it. `queries.queries()` holds the registered queries and
`queries.oracle_sql()` the SQL that checks those that SQL can express.
"""
