"""envmon.plans"""
