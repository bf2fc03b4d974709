"""Column expressions: text keys, money, dates and classifiers."""
