"""Training-data operators: near-duplicates, language, quality, decontamination, packing,
toxicity, chat formatting, repeated passages, personal data and quality rules.

Nothing outside this package imports it; ``tallyweave.llm.registry`` lists its queries.
"""
