"""Runnable jobs and the registered queries."""
