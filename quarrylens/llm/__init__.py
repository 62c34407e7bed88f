"""Operators for training-data pipelines (similarity, quality, leakage, mixing, levels).

Nothing outside this subpackage imports it; ``quarrylens.llm.queries`` holds the
registered queries and their SQL.
"""
