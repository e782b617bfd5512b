"""wattmill: energy-data analytics as Spark DataFrame jobs.

Every public operator takes DataFrames and returns DataFrames keyed by meter,
file or bill.  Nothing is collected to the driver.
"""
