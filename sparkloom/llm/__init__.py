"""Training-data operators: personal data, LM scoring, near-duplicates, WARC, packing and their queries.

Nothing else in the library imports this subpackage.
"""
