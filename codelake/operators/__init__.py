"""Structure, binding, chunking, indexes, search, exploration, evaluation, evidence, reports."""
