"""Sources and sinks: driver-table adapters, transcript files, live JSON,
versioned snapshot tables."""
