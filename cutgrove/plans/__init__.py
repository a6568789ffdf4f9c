"""cutgrove.plans"""
