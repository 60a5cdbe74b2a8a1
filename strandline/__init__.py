"""strandline: sequence, interval, search-hit and variant analytics on Spark.

Operators are lazily evaluated ``DataFrame -> DataFrame`` functions built from
Spark SQL expressions.  ``operators`` holds them by area, ``sources`` the readers
and writers, ``functions`` scalar column builders, ``plans`` named pipelines and
registered queries, ``streaming`` the streaming forms.
"""
