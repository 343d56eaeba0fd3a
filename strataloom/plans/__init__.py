"""Target planning: modes, groups, targets, reviews."""
