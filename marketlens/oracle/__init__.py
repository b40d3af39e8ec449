"""Independent DuckDB SQL for every registered query (the correctness oracle).

The prelude rebuilds the source shape, the view, the fact and the marts from
the supplied tables in plain SQL; each report appends its final SELECT.
"""
