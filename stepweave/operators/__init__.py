"""operators of the step-graph engine."""
