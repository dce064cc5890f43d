"""Frame-to-frame operators: cleaning, index, quantiles, geo-location, joins, filters, profiles."""
