"""Operators of a training-data pipeline: near-duplicate search, decontamination, tokenising, cleaning.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
