"""Readers: format detection, Parquet, delimited text, Arrow IPC, footers."""
