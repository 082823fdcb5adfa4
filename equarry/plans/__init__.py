"""Named queries over the tables of one folder, and SQL that gives the same rows."""
