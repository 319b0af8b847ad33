"""Large-scale training-data operators: archives, dedup, filters, mixing, scans.

Nothing else in the library imports this subpackage. ``queries`` registers one
thin query per operator; the operators keep their own general interfaces.
"""
