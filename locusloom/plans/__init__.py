"""Plan building blocks: checkpoints, ordered prefixes, islands, range joins, folds, components."""
