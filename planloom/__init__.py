"""planloom: DataFrame operators for engineering-drawing and building-element tables."""
