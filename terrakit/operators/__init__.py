"""DataFrame to DataFrame operators: joins, ordering, terrain, chaining."""
