"""Sources and sinks: feed files, snapshots, notes, run logs."""
