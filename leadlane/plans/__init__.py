"""Query plans: compositions of operators over the fixture views, and their SQL oracles."""
