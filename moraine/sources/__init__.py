"""Reading table sets and schema documents; writing inventories; publishing tables."""
