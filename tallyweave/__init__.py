"""A PySpark engine for financial-statement ledgers and corpus preparation."""
