"""cutgrove: segmentation-graph analytics on PySpark."""
