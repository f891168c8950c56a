"""Whole jobs made of the operators: batch scoring, model training, audit."""
