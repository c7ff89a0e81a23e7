"""The binary log format: codec, store handle, data source and JSON lines."""
