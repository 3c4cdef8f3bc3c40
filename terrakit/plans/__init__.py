"""Rule tables, layer tables, size model, area and tile planning."""
