"""Training-data operators: each module is one operator with its own general
interface; ``queries`` registers one query per operator over the shared tables."""
