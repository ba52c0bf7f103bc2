"""Market-utilization analytics over provider x product x year tables, on PySpark."""
