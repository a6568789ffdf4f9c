"""cutgrove.operators"""
