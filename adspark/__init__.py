"""Reliability analytics for predictive models, as PySpark DataFrame operators."""
