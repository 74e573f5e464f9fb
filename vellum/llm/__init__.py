"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator lives in its own module with a general
interface; :mod:`vellum.llm.queries` applies them to the tables of a folder.
"""
