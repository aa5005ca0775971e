"""Column functions over sequences, qualities, codons, patterns and coordinates."""
