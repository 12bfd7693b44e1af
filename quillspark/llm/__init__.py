"""Training-data operators: near-duplicates, personal data, language models, packing, search, tokens, quality.

Nothing outside this package imports it; ``queries`` registers its queries and their SQL.
"""
