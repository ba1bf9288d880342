"""parlance: DataFrame operators for ordered, interval-stamped, role-attributed text rows and JSON logs."""
