"""Operators of a training-data pipeline, each over whole tables of documents.

Nothing else in the library imports this subpackage. Queries and their SQL twins are in
:mod:`tessera.llm.queries`.
"""
