"""streaming of the step-graph engine."""
