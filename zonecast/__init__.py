"""zonecast: hourly zone demand panels, past-only features, forecasts and score tables on Spark."""
