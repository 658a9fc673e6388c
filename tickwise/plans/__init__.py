"""Query plans over the generated tables: domain views, registered queries and SQL oracles."""
