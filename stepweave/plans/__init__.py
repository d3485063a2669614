"""plans of the step-graph engine."""
