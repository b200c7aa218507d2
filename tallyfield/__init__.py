"""Survey-count analytics as PySpark DataFrame jobs.

``sources`` reads and writes feeds, ``functions`` holds Column expressions,
``operators`` DataFrame-to-DataFrame steps, ``plans`` whole feed preparations,
``streaming`` the incremental part, ``queries`` the registered queries with
their SQL checks.
"""
