"""Scalar building blocks: tokens, ranks, combinations, primes."""
