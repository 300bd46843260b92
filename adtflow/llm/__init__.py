"""Training-data operators: sharding, extraction, scoring, tokenisation, scans, joins and archives.

Nothing else in the package imports this subpackage.
"""
