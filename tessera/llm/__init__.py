"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it, except the guarded registration in
``__spark_entry__.py`` and the stages of ``corpus_pipeline.py``.
"""
