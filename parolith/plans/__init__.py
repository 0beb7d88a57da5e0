"""Named queries over the tables, and the SQL each is checked against."""
