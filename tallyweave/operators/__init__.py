"""Ledger operators: DataFrame in, DataFrame out, all lazy."""
