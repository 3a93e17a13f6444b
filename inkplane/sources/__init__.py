"""Sources and sinks: pictures, label files, batches."""
