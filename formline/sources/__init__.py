"""Sources and sinks: streams and folders of records, exports, archives, and generated data."""
