"""Reading and writing records, lexicons, baselines and signals."""
