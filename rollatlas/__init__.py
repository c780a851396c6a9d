"""Rollatlas: a school-directory, geocoding and district-page engine on Spark."""
