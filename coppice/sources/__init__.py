"""Sources and sinks: text formats, column roles, splits, codes, synthetic tables."""
