"""Reading and writing snapshots, curves, submissions and rule files."""
