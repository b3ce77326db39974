"""DataFrame operators. Each takes and returns DataFrames; a few checkpoint a small table they read often."""
