"""Fleet-wide device-fault analytics on Spark DataFrames.

Every table carries its grouping keys (``report_id`` and, for dumps, a file
id) plus an integer order column that is unique inside the keys.  Ordered
operators never put one key's rows into one task: see
``fleetfault.operators.ordering``.
"""
