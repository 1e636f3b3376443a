"""Column expressions: text cleaning, list literals, URLs and scores."""
