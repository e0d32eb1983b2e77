"""Reading and writing experiments."""
