"""arrears: a Spark-native analytics engine for collection call-centre data.

Raw relations (calls, contacts, promises, payments, cases, users) are turned
into fact and dimension DataFrames, KPIs, marts and data-quality reports.
Everything is lazy DataFrame code; nothing runs until an action.
"""

__version__ = "0.1.0"
