"""Training-data operators: each module holds one operator and its thin query.

Nothing else in the library imports this subpackage.
"""
