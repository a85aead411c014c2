"""Tables, views and file listings."""
