"""Training-data operators: filters, de-duplication, mixing, packing, archives, search."""
