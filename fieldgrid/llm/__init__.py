"""Training-data operators: dedup, language, tokens, secrets, mixing, search, toxicity.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` depends on it.
"""
