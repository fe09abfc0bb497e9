"""kinweave: multi-table analytics on Spark, planned by Catalyst."""
