"""quillon: device-inventory analytics on PySpark."""
