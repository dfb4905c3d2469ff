"""Operators for preparing language-model training data.

Every module holds one operator with its own general interface; ``queries``
registers the thin ``opN_*`` queries.  Nothing outside this subpackage
imports it, apart from ``__spark_entry__`` and ``corpus_pipeline``.
"""
