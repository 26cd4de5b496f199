"""Query plans: catalogue tables, registered queries and their oracle SQL."""
