"""Commerce analytics as Spark jobs: shop reports, customer grading, catalog,
coupons, payments, ledgers, audits and their streaming forms.

Every public function takes DataFrames and explicit parameters and returns a
lazy DataFrame (or a dict of them).  Nothing here collects rows on the driver.
"""

__version__ = "0.1.0"
