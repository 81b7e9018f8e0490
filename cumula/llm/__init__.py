"""Training-data operators: text, token and near-duplicate jobs over document tables.

Nothing outside this subpackage imports it; ``queries.py`` and
``corpus_pipeline.py`` register its queries.
"""
