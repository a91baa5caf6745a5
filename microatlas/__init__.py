"""microatlas: reports, trends and profiles over examination microdata, on Spark."""
