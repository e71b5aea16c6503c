"""Telemetry anomaly engine on PySpark: clean, split, window, scale, inject, score, report."""
