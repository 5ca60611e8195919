"""Training-data operators: de-duplication, filtering, classification, privacy, packing.

Nothing outside this subpackage imports it.
"""
