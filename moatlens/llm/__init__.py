"""Operators for preparing training corpora.

One module per operator (the Spark code), ``queries`` holds the thin
``opN_<name>`` queries and ``oracles`` their DuckDB SQL. Nothing outside this
subpackage imports it.
"""
