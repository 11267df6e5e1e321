"""Training-data operators over the ``documents`` and ``pages`` tables.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; :mod:`popspark.llm.queries` binds them to the registered
queries.
"""
