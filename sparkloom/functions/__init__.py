"""Scalar families: text, bits, digests, alignment."""
