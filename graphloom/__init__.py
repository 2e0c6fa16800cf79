"""graphloom: property-graph analytics and data-processing operators on PySpark."""
