"""Landing tables, archives, seeds and sinks."""
