"""Operators of a training-data pipeline, written as Spark jobs.

Nothing outside this package imports it; its queries are in
:mod:`velostat.llm.queries`."""
