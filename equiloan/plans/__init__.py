"""Query plans: input views, the registered query catalog and its SQL oracle."""
