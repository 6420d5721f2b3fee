"""End-to-end plans: training (M18), batch scoring (M17), and the catalogue
of registered queries with their SQL oracles."""
