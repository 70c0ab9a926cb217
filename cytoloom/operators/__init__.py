"""DataFrame to DataFrame operators of the engine."""
