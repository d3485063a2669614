"""functions of the step-graph engine."""
