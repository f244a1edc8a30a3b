"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries that
``__spark_entry__.py`` adds when the subpackage is present.
"""
