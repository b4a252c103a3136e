"""Table operators: cleaning, canonical values, duplicates, profiles, join discovery, relational helpers."""
