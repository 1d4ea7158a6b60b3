"""Live logs: boundaries and folds over streams of facts."""
