"""Program text: parsing, checking, typing."""
