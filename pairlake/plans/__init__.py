"""Views over the driver tables that queries run on, each with its SQL twin."""
