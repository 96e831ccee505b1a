"""Operations for preparing training data, each with its own module.

Nothing outside this folder imports it. ``llm.queries`` holds the registered queries.
"""
