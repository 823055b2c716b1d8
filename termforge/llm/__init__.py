"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()``
are read by the repository's entry module when the folder is present.
"""
