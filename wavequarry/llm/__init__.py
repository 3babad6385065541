"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers
its queries when it is present.
"""
