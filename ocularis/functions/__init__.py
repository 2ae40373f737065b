"""Spark-first building blocks of Ocularis."""
