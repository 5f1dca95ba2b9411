"""Analysis tables, query catalog and oracle SQL."""
