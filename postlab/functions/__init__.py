"""Column-level functions: text rules, stemming steps, vector arithmetic, label coding."""
