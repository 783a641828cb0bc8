"""Column expressions: hashing, activations and network forward passes."""
