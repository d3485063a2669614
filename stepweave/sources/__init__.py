"""sources of the step-graph engine."""
