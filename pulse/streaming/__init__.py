"""The daily activity and keyword-rate jobs over a table that keeps growing."""
