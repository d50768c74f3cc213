"""Query plans: the registered queries with their SQL, and the engine facade."""
