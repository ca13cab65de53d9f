"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with its own general interface; the thin
``opN_<name>`` queries that apply them to whole tables are in ``registry``.
"""
