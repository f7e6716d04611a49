"""Column-level helpers and distributed building blocks shared by operators."""
