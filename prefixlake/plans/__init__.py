"""Multi-table jobs: import, build, publish, suppress and prune releases."""
