"""Fixed dimensions: rules, dialects, and the derived statement corpus."""
