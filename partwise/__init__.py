"""Partwise: a Spark-native engine for grouped evaluation data.

Curation, similarity graphs, leakage-free splits, grouped error metrics,
resampling inference, interval coverage and event-ledger analytics, written as
lazy DataFrame compositions. The optional subpackage ``llm`` adds operators
for training-data pipelines; nothing outside it imports it.
"""
