"""Prepare prompt/answer data sets and evaluate text-generation runs on Spark.

Every operator takes and returns DataFrames (or Columns) and stays lazy. Only
:mod:`evalweave.sources`, :mod:`evalweave.streaming` and :mod:`evalweave.plans`
write tables.
"""
