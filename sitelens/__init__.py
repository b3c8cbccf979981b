"""sitelens: corpus-scale site and front-end audit on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.  Modules:

* ``sources``   – readers for the input tables and the derived ``requests`` /
  ``site_files`` views.
* ``functions`` – fixed value lists, regex constants and Column helpers.
* ``operators`` – the audit operators (traffic, html, scan, bundle, routes, …).
* ``plans``     – assembled multi-operator jobs (audit result, reports, bundles).
* ``streaming`` – Structured Streaming forms of the traffic operators.
"""

__version__ = "0.1.0"
