"""Operations of a large-scale training-data pipeline, as Spark jobs.

Each module holds one operator with a general interface, and the thin
registered query that applies it to its whole table.  ``registry`` gathers
the queries and their SQL; nothing outside this subpackage imports it but
``__spark_entry__.py`` (behind a guard) and ``corpus_pipeline.py``.
"""
