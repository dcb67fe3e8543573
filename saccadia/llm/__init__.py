"""Training-data operators: deduplication, fingerprints, scoring, tokens, decontamination, extraction, language and chat.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
