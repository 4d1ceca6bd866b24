"""Operators for training-data pipelines. Nothing outside this folder imports them but __spark_entry__.py."""
