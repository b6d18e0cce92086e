"""Training-data operators: ten corpus-scale operations on document tables.

Self-contained: nothing else in ``quern`` imports this subpackage.
"""
