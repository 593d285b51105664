"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``cellplan.llm.queries`` holds the registered queries.
"""
