"""Operators for preparing training text, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it. Every operator reads only the columns it names,
so extra columns and their names don't matter; ``documents`` has doc_id, text, lang, source.
"""
