"""Operators for large training-data pipelines.

One module per operator, each with a general DataFrame interface.  The thin
``opN_<name>`` queries that apply them to the given tables are in
``queries.py``.  Nothing outside this package imports it, except the guarded
registration in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
