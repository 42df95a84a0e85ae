"""Operators for preparing training text at scale; queries and their SQL are in :mod:`eventframe.llm.queries`."""
