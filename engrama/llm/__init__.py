"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; see ``queries.py`` for the
registered queries and ``corpus_pipeline.py`` at the repository top for the
end-to-end pipeline.
"""
