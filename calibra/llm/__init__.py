"""Training-data operators: ten corpus operators, their queries and DuckDB oracles.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries only when
it can be imported. ``queries.QUERIES`` maps names to callables, ``queries.ORACLES`` to SQL.
"""
