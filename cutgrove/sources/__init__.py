"""cutgrove.sources"""
