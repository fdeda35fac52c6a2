"""Training-data operators: each is a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered
queries with their production parameters, ``oracles.py`` the DuckDB SQL.
"""
