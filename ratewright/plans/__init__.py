"""Multi-step jobs: fitting an ensemble and rewriting it as tables."""
