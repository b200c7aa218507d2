"""The incremental part: surveys are batch tables, so it is the list of pending work."""
