"""Training-corpus operators.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when it
can be imported.  Each module holds one operator with a general interface and the thin
``opN_*`` query that applies it to the driver's tables.
"""
