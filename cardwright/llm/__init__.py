"""Training-data operators: the ten numbered operators and their queries.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its
queries only when it is there).
"""
