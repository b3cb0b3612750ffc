"""Column-level helpers: name rule, sentinels, bins, clipping, tail probabilities, guards."""
