"""Policy corpus analytics expressed as Spark DataFrame transformations.

Sub-packages: ``functions`` (Column expressions), ``sources`` (readers), ``operators``
(DataFrame -> DataFrame), ``plans`` (end-to-end compositions), ``streaming``.
"""
