"""Operators for preparing language-model training data, built on DataFrames.

Nothing outside this folder, `tests/llm`, `corpus_pipeline.py` and the guarded
lines of `__spark_entry__.py` imports it.
"""
