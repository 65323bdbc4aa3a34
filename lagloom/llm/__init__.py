"""Training-data operators: dedup, tokens, packing, classifiers, similarity.

Nothing else in the library imports this subpackage.
"""
