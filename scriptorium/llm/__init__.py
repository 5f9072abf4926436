"""Training-data operators: one module per operator, plus their queries and oracle SQL.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
