"""Column functions and small frame helpers."""
