"""Functions of program blocks, and symbols."""
