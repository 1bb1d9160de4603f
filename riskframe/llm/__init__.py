"""Operators of a training-data pipeline (dedup, filtering, scoring, packing).

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is there.
"""
