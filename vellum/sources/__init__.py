"""Sources and sinks of the curation pipeline."""
