"""Training-data operators: packing, near duplicates, scans, models, exact substring removal."""
