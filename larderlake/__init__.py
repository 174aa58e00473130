"""Item-store analytics on DataFrames: keyed tables, queries, writes, change feeds and replicas."""
