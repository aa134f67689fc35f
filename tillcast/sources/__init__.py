"""Sources and sinks: driver tables, derived panels, CSV/text formats."""
