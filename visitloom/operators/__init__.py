"""Relational operators over visits, snapshots, catalogues and logs."""
