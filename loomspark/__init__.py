"""loomspark: a Spark-native context engine.

Conversations, memories, ledgers and signals are DataFrames keyed by session;
every operator is a plan over many sessions at once.
"""

__version__ = "0.1.0"
