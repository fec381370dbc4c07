"""From a checked program to an order of evaluation."""
