"""Training-data operators: formatting, cleaning, de-duplication, mixing, packing and search.

Nothing else in the library imports this subpackage.
"""
