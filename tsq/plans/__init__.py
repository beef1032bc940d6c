"""Parser, match clauses, time domain and compiler of the expression language."""
