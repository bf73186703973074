"""The table of registered queries: name -> (spark, sf_dir) -> DataFrame."""

from zonecast.functions.tables import rounded

QUERIES = {}


def query(function):
    """Register under the function's name; doubles are rounded to 6 digits for comparison."""

    def run(spark, sf):
        return rounded(function(spark, sf))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function
