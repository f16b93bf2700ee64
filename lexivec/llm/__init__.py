"""Operators for training data: similar vectors, look-alikes, garbled text, calibrated samples, packing, mixing, splitting.

Nothing outside this subpackage imports it.
"""
