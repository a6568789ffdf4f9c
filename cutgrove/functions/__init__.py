"""cutgrove.functions"""
