"""What to compute: sizes, partitions, fold geometry and plans."""
