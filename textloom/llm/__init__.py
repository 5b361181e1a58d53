"""Training-data operators: packing, deduplication, filtering and scoring of whole corpora.

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
