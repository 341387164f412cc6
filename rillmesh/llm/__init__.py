"""Training-data operators: ten distributed corpus operations and their queries."""
