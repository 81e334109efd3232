"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; intermediate tables go to the shared folder that the session
names in ``spark.checkpoint.dir``.
"""
