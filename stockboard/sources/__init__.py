"""Sources and sinks: tables, entity views, scans, generators, graph tables, snapshots."""
