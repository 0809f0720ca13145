"""Operators for large text corpora: token counts, language, quality, near copies, packing and the like.

Nothing outside this subpackage imports it; ``terrane.llm.registry`` holds its queries and their SQL.
"""
