"""Driver-side planning: schema contract, join paths, questions, the SQL guard, answers."""
