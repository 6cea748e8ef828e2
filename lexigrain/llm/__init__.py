"""Operators for preparing training text: codecs, near-duplicate detection, sharding, archives,
packing, classifiers, personal data and media columns.

Nothing else in the library imports this subpackage; its queries are in ``queries``.
"""
