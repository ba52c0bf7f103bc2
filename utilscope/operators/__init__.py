"""DataFrame operators: cleaning, classification, aggregates, ranks, scores and checks."""
