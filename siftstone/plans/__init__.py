"""Plans: loops, reports and the facade over the operators."""
