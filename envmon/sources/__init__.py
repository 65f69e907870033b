"""envmon.sources"""
