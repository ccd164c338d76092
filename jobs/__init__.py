"""Runnable jobs over given tables: each a function that takes a session and plain paths, and a command line.

`queries()` has each as a registered query over the driver's tables, `oracle_sql()` the SQL that checks it.
"""
