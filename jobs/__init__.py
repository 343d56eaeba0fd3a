"""Runnable jobs: batch_targets (batch) and name_register (incremental)."""
