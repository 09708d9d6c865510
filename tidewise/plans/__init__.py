"""Plan helpers shared by the operators: scratch tables and size-checked joins."""
