"""Scalar functions: column expressions, and a few Arrow functions where no expression can say it."""
