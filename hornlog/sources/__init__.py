"""Reading facts and writing relations."""
