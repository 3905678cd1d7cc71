"""Operators for large-scale training-data pipelines (text corpora).

Nothing else in the library imports this subpackage; its queries are in
``queries.py`` and its stages in ``corpus_pipeline.py`` at the repository top.
"""
