"""Registered queries with the SQL that checks them."""
