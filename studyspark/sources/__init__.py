"""Files, state, fetching, models and sinks."""
