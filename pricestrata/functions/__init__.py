"""Part of pricestrata."""
