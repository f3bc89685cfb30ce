"""Training-data operators: ten of them, each in a module of its own, and their queries in `queries`."""
