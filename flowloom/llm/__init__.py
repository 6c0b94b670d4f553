"""Operators for preparing training text at corpus scale.

Every operator is a ``DataFrame -> DataFrame`` function in a module of its own;
``catalogue`` names the queries that apply them to the test tables.
"""
