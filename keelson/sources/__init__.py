"""Schemas, readers and writers, and the driver-table mapping."""
