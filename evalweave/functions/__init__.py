"""Column functions: text, chat messages, arrays and scalar parsing."""
