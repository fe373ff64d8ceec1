"""Operators for preparing large-scale training data.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries when it is present.
"""
