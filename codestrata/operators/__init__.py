"""DataFrame operators over the entity and relationship tables."""
