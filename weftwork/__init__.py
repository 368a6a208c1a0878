"""Dataset workflows and large-scale text operators, declared as PySpark plans."""
