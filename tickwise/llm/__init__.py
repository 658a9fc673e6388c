"""Operators for preparing training corpora, and the queries that apply them.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
