"""Sources and sinks: snapshot files, fetched bodies, the source catalogue."""
