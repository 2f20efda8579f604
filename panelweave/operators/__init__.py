"""DataFrame operators, grouped by the stage of the analysis they serve."""
