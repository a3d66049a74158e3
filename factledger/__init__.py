"""Spark-native temporal fact ledger: operators over DataFrames of facts, eras and rules."""
