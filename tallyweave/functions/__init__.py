"""Column functions: money, dates, descriptions, features and scores."""
