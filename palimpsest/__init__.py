"""Document-version reconciliation and corpus preparation on PySpark."""
