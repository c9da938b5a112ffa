"""Registered queries with the SQL that checks them."""

from gameline.catalog import betting, cleaning, datasets, models, preparation, quoting, series, teams

ALL = {}
for _part in (cleaning, series, teams, datasets, betting, quoting, preparation, models):
    ALL.update(_part.QUERIES)
