"""Observability analytics on Spark: logs, metrics, traces and profiles as DataFrame plans."""
