"""Column functions: parsing of messy numbers, dates and booleans, and string similarity."""
