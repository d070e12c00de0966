"""Cohort and spatial-omics analytics as Spark DataFrame operators.

``functions``  column expressions and small vectorised helpers
``operators``  DataFrame in, tidy DataFrame out
``sources``    fixed schemas, readers, writers, table checks
``plans``      the operators applied to concrete tables, each with its SQL twin
"""
