"""What statements answer."""

#: The texts that clients know, in the order of the statements they belong to.
NO_TABLE = "Table '{}' does not exist"
NO_NAME = "Table name cannot be empty"
NO_COLUMNS = "Table must have at least one column"
NO_KEY = "Table must have a PRIMARY KEY"
TABLE_EXISTS = "Table '{}' already exists"
CREATED = "Table '{}' created."
DROPPED = "Table '{}' dropped."
NOTHING_DROPPED = "OK"
COUNTS_DIFFER = "Column count ({}) doesn't match value count ({})"
NO_COLUMN_IN = "Unknown column '{}' in table '{}'"
NULL_CELL = "Column '{}' cannot be NULL"
NULL_KEY = "PRIMARY KEY '{}' value required"
SAME_KEY = "Duplicate PRIMARY KEY value: {}"
INSERTED = "1 row inserted."
NO_COLUMN = "Unknown column '{}'"
UNSORTABLE = "ORDER BY column '{}' must be in SELECT list"
RETURNED = "{} row(s) returned."
UPDATED = "{} row(s) updated."
DELETED = "{} row(s) deleted."
TABLES = "{} table(s)."
COLUMNS = "{} column(s)."
