"""Sources and sinks: file scans, the results table, graph export."""
