"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
live in :mod:`choicefold.llm.queries`.
"""
