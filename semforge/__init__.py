"""semforge: a Spark-first engine for ontology-driven operational data.

Every operator takes and returns DataFrames; nothing here writes to its inputs.
"""
